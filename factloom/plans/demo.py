"""Star-schema tables seen as facts, wiki markup and annotated sentences, so that every operator runs on tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.fixed import NAMESPACES, RAW_PROPERTY
from factloom.functions.text import admissible
from factloom.functions.wording import common_wording
from factloom.operators.depgraph import pseudo_parse

ONT, RES, XSD, UNIT = NAMESPACES["dbpedia-owl"], NAMESPACES["dbpedia"], NAMESPACES["xsd"], NAMESPACES["dbpdatatype"]
RDFS, RDF = NAMESPACES["rdfs"], NAMESPACES["rdf"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fact(df: DataFrame, subject: str, key: str, p: str, kind: str, value: Column, datatype: str | None = None, lang: str | None = None, label: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.concat(F.lit(f"http://ex/{subject}/"), F.col(key)).alias("subject"), F.lit(p).alias("p"), F.lit(kind).alias("o_type"), value.cast("string").alias("o_value"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(lang).cast("string").alias("o_lang"), (none if label is None else label).alias("label"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about customers, suppliers, parts, orders and nations."""
    t = lambda name: table(spark, sf_dir, name)
    nation, region, customer, supplier, part, orders = (t(n) for n in ("nation", "region", "customer", "supplier", "part", "orders"))
    money = lambda c: F.format_string("%.2f", c)
    place = lambda c: F.concat(F.lit(RES), c)
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    facts = [
        _fact(c, "customer", "c_custkey", RDFS + "label", "literal", F.col("c_name"), lang="en"),
        _fact(c, "customer", "c_custkey", ONT + "balance", "typed-literal", money(F.col("c_acctbal")), XSD + "double"),
        _fact(c, "customer", "c_custkey", ONT + "nation", "uri", place(F.col("n_name")), label=F.col("n_name")),
        _fact(c, "customer", "c_custkey", RDF + "type", "uri", F.lit(ONT + "Customer")),
        _fact(s, "supplier", "s_suppkey", ONT + "balance", "typed-literal", money(F.col("s_acctbal")), XSD + "float"),
        _fact(s, "supplier", "s_suppkey", RAW_PROPERTY + "/name", "literal", F.col("s_name"), lang="de"),
        _fact(s, "supplier", "s_suppkey", ONT + "nation", "uri", place(F.col("n_name")), label=F.col("n_name")),
        _fact(part, "part", "p_partkey", ONT + "size", "typed-literal", F.col("p_size"), XSD + "int"),
        _fact(part, "part", "p_partkey", ONT + "area", "typed-literal", F.col("p_size") * 1000, UNIT + "squareKilometre"),
        _fact(part, "part", "p_partkey", ONT + "width", "typed-literal", F.col("p_size"), UNIT + "inch"),
        _fact(part, "part", "p_partkey", ONT + "place", "typed-literal", F.col("p_size"), UNIT + "Geometry"),
        _fact(part, "part", "p_partkey", ONT + "kind", "literal", F.col("p_type"), lang="en"),
        _fact(orders, "order", "o_orderkey", ONT + "date", "typed-literal", F.date_format("o_orderdate", "yyyy-MM-dd"), XSD + "date"),
        _fact(n, "nation", "n_nationkey", ONT + "region", "uri", place(F.col("r_name")), label=F.col("r_name")),
    ]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """labels(iri, label, lang), redirects(from_iri, to_iri) and types(iri, kind, class) of nations and regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n, k = F.concat(F.lit(RES), F.col("n_name")), F.concat(F.lit(RES + "N"), F.col("n_nationkey"))
    labels = nation.select(n.alias("iri"), F.col("n_name").alias("label"), F.lit("en").alias("lang"))
    labels = labels.unionByName(nation.select(k.alias("iri"), F.concat(F.lit("Nation "), F.col("n_nationkey")).alias("label"), F.lit("en").alias("lang")))
    labels = labels.unionByName(nation.select(k.alias("iri"), F.concat(F.lit("Land "), F.col("n_nationkey")).alias("label"), F.lit("de").alias("lang")))
    labels = labels.unionByName(region.select(F.concat(F.lit(RES), F.col("r_name")).alias("iri"), F.col("r_name").alias("label"), F.lit("en").alias("lang")))
    redirects = nation.select(k.alias("from_iri"), n.alias("to_iri"))
    types = nation.filter("n_nationkey % 2 = 0").select(n.alias("iri"), F.lit("range").alias("kind"), F.lit(ONT + "Country").alias("class"))
    types = types.unionByName(nation.filter("n_nationkey % 3 = 0").select(n.alias("iri"), F.lit("type").alias("kind"), F.lit(ONT + "Place").alias("class")))
    return labels, redirects, types


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return t.select("subject", "p", common_wording(F.col("o_type"), F.col("o_value"), F.col("o_datatype"), F.col("label")).alias("wording"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts(subject, p, wording) about documents: frequent words, a name that no text has, an ignored predicate, a fact without wording."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    by_lang = lambda *w: F.create_map(*[F.lit(x) for pair in zip(("en", "fr", "de", "es"), w, strict=True) for x in pair])[F.col("lang")]
    rows = [(ONT + "article", by_lang("the", "la", "der", "el")), (ONT + "link", by_lang("of", "de", "und", "de")), (ONT + "join", by_lang("and", "et", "die", "que")), (ONT + "absent", F.lit("Nowhere")), (RDFS + "comment", F.lit("the")), (ONT + "mute", F.lit(None).cast("string"))]
    return docs.select(F.col("doc_id").alias("subject"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), w.alias("wording")) for p, w in rows])).alias("f")).select("subject", "f.*")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences(article, lang, sentence_id, sentence): the admissible lines of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "sentence"))
    rows = docs.select(F.col("doc_id").alias("article"), "lang", (F.col("doc_id") * 1000000000 + F.col("at")).alias("sentence_id"), "sentence")
    return rows.filter(admissible(F.col("sentence")) & (F.trim("sentence") != ""))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_parse(lines(spark, sf_dir).select("sentence_id", "sentence", "article"))


def wordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """subjects(article, wording, root) and objects(article, predicate, wording, root) of documents."""
    facts = document_facts(spark, sf_dir).filter(F.startswith("p", F.lit(ONT)) & F.col("wording").isNotNull())
    s = facts.filter(F.col("p") == ONT + "article").select(F.col("subject").alias("article"), "wording", F.col("wording").alias("root"))
    o = facts.filter(F.col("p") != ONT + "article").select(F.col("subject").alias("article"), F.col("p").alias("predicate"), "wording", F.col("wording").alias("root"))
    return s, o


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(page_id, lang, title, text): parts as articles in wiki markup.

    A part takes a few bytes of its file and an article much work, so parts are dealt out first: by bytes, all would go to a few tasks."""
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = part.join(nation, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    text = F.concat(
        F.lit("{{convert|"), size, F.lit("|mi}} and {{convert|"), size, F.lit("|sqmi}}, {{lang|fr|"), name, F.lit("}} {{as of|1999}} {{nhly|1998}} {{unknown|x}}\n"),
        F.lit("[[Region:X]] [["), F.col("n_name"), F.lit("|link]]s [["), F.col("n_name"), F.lit("]] '''"), name, F.lit("''' [http://a.org/x the site] ''italic''\n"),
        F.lit("== Size ==\nBuilt on 21 August 1999 and 3 January <b>x</b>.\n"),
        F.lit("[[Category:"), F.col("p_brand"), F.lit("|*]] [[Category:"), F.col("p_type"), F.lit("|*]] [[Category:Bare]] [[de:"), name, F.lit("]]"),
    )
    return rows.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 3 == 0, "de").otherwise("en").alias("lang"), name.alias("title"), text.alias("text"))


def article_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(page_id, lang, title, text): documents as articles in wiki markup, their lines as paragraphs with bold and italic
    words, links, templates, lists, comments, headers and formulas, each at places that follow from the line's number."""
    docs = table(spark, sf_dir, "documents")
    first, rest = (lambda s: F.split_part(s, F.lit(" "), F.lit(1))), (lambda s: s.substr(F.length(F.split_part(s, F.lit(" "), F.lit(1))) + 1, F.length(s)))

    def dressed(s: Column, i: Column) -> Column:
        put = lambda before, after: F.concat(F.lit(before), first(s), F.lit(after), rest(s))
        return (
            F.when(i % 7 == 0, put("'''", "'''")).when(i % 7 == 1, put("[[Page of|", "]]")).when(i % 7 == 2, put("{{note|x}}", "<!-- no -->"))
            .when(i % 7 == 3, put("* ", "")).when(i % 7 == 4, put("''", "''")).when(i % 7 == 5, F.concat(F.lit("== Part ==\n"), s)).otherwise(put("key: ", " <math>x</math>"))
        )

    lines = F.transform(F.split("text", "\n"), dressed)
    text = F.concat(F.array_join(lines, "\n\n"), F.lit("\n\n[[de:Seite]]"))
    return docs.select(F.col("doc_id").alias("page_id"), "lang", F.col("source").alias("title"), text.alias("text"))
