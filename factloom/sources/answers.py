"""Facts from files: N-Triples, stored answers of a query service, and the policy for asking one.

No network is used here. ``answer`` takes the function that asks; what it returns is stored once for each query.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")
TRIPLE = "subject string, p string, o_type string, o_value string, o_datatype string, o_lang string"
_IRI, _BLANK = r"<([^>]*)>", r"(_:\S+)"
_LINE = rf'^\s*(?:{_IRI}|{_BLANK})\s+{_IRI}\s+(?:{_IRI}|{_BLANK}|"((?:[^"\\]|\\.)*)"(?:\^\^{_IRI}|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
#: One value of a SPARQL JSON result.
_VALUE = "struct<type:string,value:string,datatype:string,`xml:lang`:string>"


def unescaped(text: Column) -> Column:
    """The characters that N-Triples and JSON name by ``\\t \\n \\r \\" \\\\ \\uXXXX`` and ``\\UXXXXXXXX``."""
    # a code point beyond 16 bits becomes two units, which only a decoder of JSON puts together
    wide = F.regexp_extract_all(text, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1))
    code = lambda x: F.conv(x, 16, 10).cast("long")
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    pair = lambda n: F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
    units = F.transform(wide, lambda x: F.when(code(x) < 0x10000, unit(code(x))).otherwise(pair(code(x))))
    pieces = F.split(text, r"\\U[0-9A-Fa-f]{8}")
    joined = F.array_join(F.zip_with(pieces, units, lambda p, u: F.concat(p, F.coalesce(u, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("\\")), F.from_json(F.concat(F.lit('{"v":"'), joined, F.lit('"}')), "v string")["v"]).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Facts out of N-Triples files, compressed or not."""
    return ntriples(spark.read.text(path))


def ntriples(lines: DataFrame) -> DataFrame:
    """Rows (subject, p, o_type, o_value, o_datatype, o_lang) of lines(value) in N-Triples; lines that are none are left out."""
    part = lambda k: F.regexp_extract("value", _LINE, k)
    some = lambda k: F.when(part(k) != "", part(k))
    rows = lines.filter(F.rlike("value", F.lit(_LINE)))
    kind = F.when(some(4).isNotNull(), "uri").when(some(5).isNotNull(), "bnode").when(some(7).isNotNull(), "typed-literal").otherwise("literal")
    return rows.select(F.coalesce(some(1), some(2)).alias("subject"), part(3).alias("p"), kind.alias("o_type"), unescaped(F.coalesce(some(4), some(5), part(6))).alias("o_value"), some(7).alias("o_datatype"), some(8).alias("o_lang"))


def bindings(answers: DataFrame, names: list[str], column: str = "body") -> DataFrame:
    """One row for each solution in stored SPARQL JSON results, with a struct (type, value, datatype, lang) for each name.

    Escapes of eight digits, which JSON does not have, are repaired first."""
    kind = "struct<results:struct<bindings:array<struct<" + ",".join(f"`{n}`:{_VALUE}" for n in names) + ">>>>"
    repaired = F.regexp_replace(F.col(column), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    rows = answers.select(F.explode(F.from_json(repaired, kind)["results"]["bindings"]).alias("b"))
    return rows.select(*[F.struct(*[F.col(f"b.{n}.{f}").alias(a) for f, a in (("type", "type"), ("value", "value"), ("datatype", "datatype"), ("`xml:lang`", "lang"))]).alias(n) for n in names])


def triples_of(solutions: DataFrame, subject: str) -> DataFrame:
    """Facts about one subject out of solutions(p, o), with the label of an object if there is a column label."""
    label = F.col("label.value") if "label" in solutions.columns else F.lit(None).cast("string")
    return solutions.select(F.lit(subject).alias("subject"), F.col("p.value").alias("p"), F.col("o.type").alias("o_type"), F.col("o.value").alias("o_value"), F.col("o.datatype").alias("o_datatype"), F.col("o.lang").alias("o_lang"), label.alias("label"))


def query_key(query: str) -> str:
    return hashlib.sha224(query.encode()).hexdigest()


def patiently(ask: Callable[[], Result], seconds: float = 60, pause: float = 120, attempts: int = 10) -> Result:
    """What ``ask`` returns. It may take ``seconds``; after a timeout or a lost connection it is asked again after ``pause``, at most
    ``attempts`` times. A call that is too slow is left behind in a thread of its own, as nothing can stop it."""
    for attempt in range(attempts):
        found: list[Result] = []
        errors: list[BaseException] = []

        def run(found=found, errors=errors) -> None:
            try:
                found.append(ask())
            except BaseException as error:  # handed to the caller below
                errors.append(error)

        worker = threading.Thread(target=run, daemon=True)
        worker.start()
        worker.join(seconds)
        if found:
            return found[0]
        error = errors[0] if errors else TimeoutError(f"no answer in {seconds} seconds")
        if not isinstance(error, (TimeoutError, ConnectionError)) or attempt + 1 == attempts:
            raise error
        time.sleep(pause)
    raise ValueError("at least one attempt is needed")


def answer(spark: SparkSession, folder: str, query: str, ask: Callable[[str], str], use_stored: bool = True, **policy: float) -> DataFrame:
    """The answer to a query as answers(body): the stored one, or what ``ask`` returns, which is stored below folder."""
    path = f"{folder}/{query_key(query)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not use_stored or not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        body = patiently(lambda: ask(query), **policy)
        spark.createDataFrame([(query, body)], "query string, body string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("query string, body string").parquet(path).select("body")
