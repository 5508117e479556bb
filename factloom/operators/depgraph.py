"""Dependency graphs as tables.

An annotated sentence is one row: (sentence_id, text, tokens, edges) with tokens as array of (idx, word,
start, end), idx from 1 and 0 for the root, and edges as array of (tail, head, label). Graphs have at most a
few hundred nodes, so what concerns one sentence is computed inside its row.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.fixed import ENTITY_PREFIX, NUMERIC_PREFIX, OBJECT_TAG, PHRASE_RELATIONS, ROOT_TAG, SUBJECT_TAG
from factloom.functions.wording import NUMBER, TITLE_CASE
from factloom.operators import flat

EDGE = "array<struct<tail:int,head:int,label:string>>"
#: What a sentence is before it is parsed, and after.
SENTENCE, ANNOTATION = ("sentence",), ("text", "tokens", "edges")
NAMED_EDGE = "array<struct<tail:string,head:string,label:string>>"
TOKEN = "array<struct<idx:int,word:string,start:int,end:int>>"
PARSE = "struct<sentence_id:string,text:string,dependencies:array<struct<rel:string,tail:string,head:string>>,originaldependencies:array<struct<rel:string,tail:string,head:string>>,words:array<struct<word:string,CharacterOffsetBegin:string,CharacterOffsetEnd:string,NamedEntityTag:string>>>"


def index_of(node: Column) -> Column:
    """The number at the end of a node's name ``word-3``."""
    return F.regexp_extract(node, r"-(\d+)$", 1).try_cast("int")


def repair_name(name: Column) -> Column:
    """Node names that graph files cannot hold: a leading ``%`` doubles, an apostrophe at the end and spaces before a hyphen go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^%", "%%"), "'+$", ""), r" +-", "-")


#: What the parser's JSON is read as; a sentence needs one of the two lists of dependencies.
KINDS = ("originaldependencies", "dependencies")


def whole_number(text: pa.Array) -> pa.Array:
    """Strings that are integers of 32 bits; null for others."""
    digits = pc.if_else(pc.match_substring_regex(text, r"^\s*[+-]?[0-9]{1,18}\s*$"), pc.replace_substring(pc.utf8_trim_whitespace(text), "+", ""), None)
    value = pc.cast(digits, pa.int64())
    return pc.cast(pc.if_else(pc.less_equal(pc.abs(value), 2**31 - 1), value, None), pa.int32())


def node_number(name: pa.Array) -> pa.Array:
    """``index_of`` of a node's name after ``repair_name``: the number after its last hyphen, which apostrophes may follow."""
    return whole_number(pc.struct_field(pc.extract_regex(name, r"-(?P<n>[0-9]+)'*$"), 0))


def parse_annotations(rows: DataFrame, column: str = "annotation", complete: bool = True) -> DataFrame:
    """Annotations from a parser's JSON. Whole sentences use the original dependencies, short wordings the collapsed ones.
    Of several labels between two nodes the last one counts. Rows without a root are left out."""
    kind, other = KINDS if complete else KINDS[::-1]
    schema = T._parse_datatype_string(PARSE)
    schema = T.StructType([f for f in schema if f.name != other])

    def emit(batches):
        for batch in flat.parts(batches):
            j = batch.column("j").drop_null()
            deps, lists, ids, text = (flat.member(j, c) for c in (kind, "words", "sentence_id", "text"))
            ds, counts = deps.flatten(), flat.lengths(deps)
            row = np.repeat(np.arange(len(counts)), counts)
            tail, head, label = node_number(flat.plain(flat.member(ds, "tail"))), node_number(flat.plain(flat.member(ds, "head"))), flat.plain(flat.member(ds, "rel"))
            ends = np.stack([row, flat.numbers(tail, -1), flat.numbers(head, -1)])
            # of the entries between two nodes the last one, in the order of entries
            order = np.lexsort((-np.arange(len(row)), ends[2], ends[1], ends[0]))
            kept = np.sort(order[np.r_[True, (ends[:, order[1:]] != ends[:, order[:-1]]).any(0)]]) if len(order) else order
            rooted = np.bincount(row, weights=ends[1] == 0, minlength=len(counts)) > 0
            kept = kept[rooted[row[kept]]]
            at, full = pa.array(kept), pa.array(np.flatnonzero(rooted))
            edges = flat.struct_of(tail=tail.take(at), head=head.take(at), label=label.take(at))
            lists = lists.take(full)
            words, sizes = lists.flatten(), flat.lengths(lists)
            tokens = flat.struct_of(idx=flat.int32(flat.places(sizes) + 1), word=flat.plain(flat.member(words, "word")), start=whole_number(flat.plain(flat.member(words, "CharacterOffsetBegin"))), end=whole_number(flat.plain(flat.member(words, "CharacterOffsetEnd"))))
            missing = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"sentence_id": ids.take(full), "text": text.take(full), "tokens": flat.list_of(sizes, tokens, missing), "edges": flat.list_of(np.bincount(row[kept], minlength=len(counts))[rooted], edges)})

    # a step in Arrow takes the JSON once: columns made of it, or a filter over them, would read it again
    return rows.select(F.from_json(F.col(column), schema).alias("j")).mapInArrow(emit, f"sentence_id string, text string, tokens {TOKEN}, edges {EDGE}")


def annotation_json(annotations: DataFrame) -> DataFrame:
    """Rows (annotation): sentences as the parser's JSON, which ``parse_annotations`` reads."""
    name = lambda i: F.when(i == 0, "ROOT-0").otherwise(F.concat(F.get("tokens", i - 1)["word"], F.lit("-"), i.cast("string")))
    annotations = annotations.select("sentence_id", "text", "tokens", "edges")
    edges = F.transform("edges", lambda e: F.struct(e["label"].alias("rel"), name(e["tail"]).alias("tail"), name(e["head"]).alias("head")))
    words = F.transform("tokens", lambda t: F.struct(t["word"].alias("word"), t["start"].cast("string").alias("CharacterOffsetBegin"), t["end"].cast("string").alias("CharacterOffsetEnd")))
    return annotations.select(F.to_json(F.struct("sentence_id", "text", edges.alias("dependencies"), edges.alias("originaldependencies"), words.alias("words"))).alias("annotation"))


def read_annotations(spark, path: str, complete: bool = True) -> DataFrame:
    """Annotated sentences out of text files with a parser's JSON, one sentence in a line."""
    return parse_annotations(spark.read.text(path).withColumnRenamed("value", "annotation"), complete=complete)


def read_conll(spark, path: str) -> DataFrame:
    """Annotated sentences out of CoNLL-U files: blocks of lines (number, word, ..., head in column 7, relation in column 8) with an
    empty line between them. A ``# sent_id`` line names a sentence, else a hash of its text does; multi-word and empty tokens are left out."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", "\r", "").alias("v"))
    rows = F.filter(F.split("v", "\n"), lambda x: F.rlike(x, F.lit(r"^\d+\t")))
    cells = F.transform(rows, lambda x: F.split(x, "\t"))
    blocks = blocks.select("v", cells.alias("c")).filter(F.size("c") > 0)
    words = F.transform("c", lambda x: F.get(x, F.lit(1)))
    blocks = blocks.withColumn("words", words).withColumn("text", F.array_join("words", " "))
    # a fold that carries the place of the next token, as in pseudo_parse
    token = lambda acc, w: F.struct((F.size(acc["out"]) + 1).alias("idx"), w.alias("word"), acc["at"].alias("start"), (acc["at"] + F.length(w)).alias("end"))
    tokens = F.aggregate("words", F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {TOKEN})").alias("out")), lambda acc, w: F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.concat(acc["out"], F.array(token(acc, w))).alias("out")), lambda acc: acc["out"])
    edges = F.filter(F.transform("c", lambda x: F.struct(F.get(x, F.lit(6)).try_cast("int").alias("tail"), F.get(x, F.lit(0)).try_cast("int").alias("head"), F.get(x, F.lit(7)).alias("label"))), lambda e: e["tail"].isNotNull())
    named = F.regexp_extract("v", r"(?m)^# sent_id = (.*)$", 1)
    return valid_annotations(blocks.select(F.when(named != "", named).otherwise(F.sha2("text", 224)).alias("sentence_id"), "text", tokens.alias("tokens"), edges.alias("edges")))


def valid_annotations(rows: DataFrame) -> DataFrame:
    """At least one dependency, and a root among them."""
    return rows.filter((F.size("edges") > 0) & F.exists("edges", lambda e: e["tail"] == 0))


def parse_sentences(batches):
    """``pseudo_parse`` of record batches. A step that takes annotations can take it as ``parse`` with sentences instead, and
    what is known of their tokens then stays in one Python worker."""
    for batch in flat.parts(batches):
        lists = pc.split_pattern(pc.fill_null(flat.plain(batch.column("sentence")), ""), " ")
        words, counts = lists.flatten(), flat.lengths(lists)
        some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        if not some.all():
            counts = np.diff(np.r_[0, np.cumsum(some)][flat.starts_of(counts)])
            words = words.filter(pa.array(some))
        full = counts > 0
        counts, rows = counts[full], pa.array(np.flatnonzero(full))
        coded = words.dictionary_encode()  # work on words is done once for each distinct one
        says, code = coded.dictionary, coded.indices.to_numpy()
        number, title = pc.match_substring_regex(says, NUMBER), pc.and_(pc.match_substring_regex(says, TITLE_CASE), pc.match_substring_regex(says, r"\p{L}"))
        label = pc.if_else(number, "num", pc.if_else(title, "nn", "dep")).take(coded.indices)
        size = pc.utf8_length(says).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        at = flat.starts_of(size + 1)
        start = at[:-1] - np.repeat(at[flat.starts_of(counts)[:-1]], counts)
        idx = flat.places(counts) + 1
        tokens = flat.struct_of(idx=flat.int32(idx), word=words, start=flat.int32(start), end=flat.int32(start + size))
        edges = flat.struct_of(tail=flat.int32(idx >> 1), head=flat.int32(idx), label=label)
        made = {"text": pc.binary_join(flat.list_of(counts, words), " "), "tokens": flat.list_of(counts, tokens), "edges": flat.list_of(counts, edges)}
        yield pa.RecordBatch.from_pydict({"sentence_id": batch.column("sentence_id").take(rows)} | made | {c: batch.column(c).take(rows) for c in batch.schema.names if c not in ("sentence_id", "sentence")})


def pseudo_parse(sentences: DataFrame) -> DataFrame:
    """A stand-in for a parser: token i hangs off token i // 2, so the tree is shallow; labels are num, nn (title case) or dep.

    It lets the operators run where no parser is at hand; real annotations enter as a table. Other columns than the sentence stay."""
    keep = [f for f in sentences.schema if f.name not in ("sentence_id", "sentence")]
    schema = T.StructType([sentences.schema["sentence_id"], *T._parse_datatype_string(f"text string, tokens {TOKEN}, edges {EDGE}").fields, *keep])
    return sentences.select("sentence_id", "sentence", *[f.name for f in keep]).mapInArrow(parse_sentences, schema)


def dep_edges(annotations: DataFrame) -> DataFrame:
    """Rows (sentence_id, tail, head, label)."""
    return annotations.select("sentence_id", F.inline("edges"))


def token_rows(annotations: DataFrame) -> DataFrame:
    return annotations.select("sentence_id", F.inline("tokens"))


def paths_from(edges: list, root) -> dict:
    """For each node that root reaches, the shortest path; of equally short ones the smallest."""
    after: dict = {}
    for e in edges:
        after.setdefault(e["tail"], []).append(e["head"])
    paths, queue = {root: [root]}, deque([root])
    while queue:
        node = queue.popleft()
        for nxt in sorted(set(after.get(node, ()))):
            if nxt not in paths:
                paths[nxt] = [*paths[node], nxt]
                queue.append(nxt)
    return paths


def edge_walks(edges: pa.Array) -> flat.Walks:
    es, counts = edges.flatten(), flat.lengths(edges)
    return flat.walks(np.repeat(np.arange(len(edges)), counts), flat.numbers(flat.member(es, "tail"), -1), flat.numbers(flat.member(es, "head"), -1), len(edges))


def by_parts(one, edges: pa.Array) -> pa.Array:
    return pa.concat_arrays([one(edges.slice(at, flat.PART)) for at in range(0, max(len(edges), 1), flat.PART)])


@F.arrow_udf(T.ArrayType(T.StructType().add("node", T.IntegerType()).add("path", T.ArrayType(T.IntegerType()))))
def root_paths(edges: pa.Array) -> pa.Array:
    """Shortest paths from the root of each sentence, of equally short ones the smallest; nodes without one are left out."""

    def one(es):
        w, null = edge_walks(es), es.is_null().to_numpy(zero_copy_only=False)
        w.depth[null[w.row]] = -1
        at, counts, nodes = w.paths()
        found = flat.struct_of(node=flat.int32(w.node[at]), path=flat.list_of(counts, flat.int32(nodes)))
        return flat.list_of(np.bincount(w.row[at], minlength=len(es)), found, null)

    return by_parts(one, edges)


@F.arrow_udf(T.StructType().add("nodes", T.IntegerType()).add("reached", T.IntegerType()))
def reach(edges: pa.Array) -> pa.Array:
    """How many nodes a graph's edges name, one that is missing included, and how many the root reaches."""

    def one(es):
        w, null = edge_walks(es), es.is_null().to_numpy(zero_copy_only=False)
        ends, row = es.flatten(), np.repeat(np.arange(len(es)), flat.lengths(es))
        tail, head = flat.numbers(flat.member(ends, "tail"), -1), flat.numbers(flat.member(ends, "head"), -1)
        width = int(max(tail.max(initial=0), head.max(initial=0))) + 2
        nodes = np.bincount(np.unique(np.r_[row * width + tail + 1, row * width + head + 1]) // width, minlength=len(es))
        reached = np.bincount(w.row[w.depth >= 0], minlength=len(es))
        return flat.struct_of(nodes=pa.array(nodes, pa.int32(), mask=null), reached=pa.array(reached, pa.int32(), mask=null))

    return by_parts(one, edges)


@F.pandas_udf(T.ArrayType(T.StructType().add("side", T.StringType()).add("step", T.IntegerType()).add("label", T.StringType()).add("name", T.StringType())))
def pattern_paths(edges: pd.Series) -> pd.Series:
    """For a pattern's edges (tail, head, label by name): the labelled paths from its root to subject and object; null if one is missing."""

    def both(es):
        if es is None:
            return None
        labels = {}
        for e in es:
            labels.setdefault((e["tail"], e["head"]), e["label"])
        paths = paths_from(list(es), ROOT_TAG)
        if SUBJECT_TAG not in paths or OBJECT_TAG not in paths:
            return None
        out = []
        for side, tag in (("subject", SUBJECT_TAG), ("object", OBJECT_TAG)):
            p = paths[tag]
            out += [{"side": side, "step": i + 1, "label": labels[p[i], p[i + 1]], "name": p[i + 1]} for i in range(len(p) - 1)]
        return out

    return edges.map(both)


#: As nondeterministic functions they are evaluated once for a row and never copied into a filter or a join condition.
root_paths, reach, pattern_paths = root_paths.asNondeterministic(), reach.asNondeterministic(), pattern_paths.asNondeterministic()


def reached_from_root(annotations: DataFrame) -> DataFrame:
    """Rows (sentence_id, nodes, reached): a graph with fewer reached nodes than nodes is not connected from its root."""
    return annotations.select("sentence_id", reach("edges").alias("r")).select("sentence_id", "r.nodes", "r.reached")


def word_at(tokens: Column, idx: Column) -> Column:
    return F.get(tokens, idx - 1)["word"]


def span_of(text: Column, tokens: Column, edges: Column, node: Column) -> Column:
    """Struct (nested, wording): the noun phrase around a node, cut out of the text from its first to its last token; for
    a node that is itself part of a phrase, nested is true and the wording is its own word."""
    inside = lambda e: e["label"].isin(PHRASE_RELATIONS)
    nested = F.exists(edges, lambda e: (e["head"] == node) & (e["tail"] != 0) & inside(e))
    heads = F.transform(F.filter(edges, lambda e: (e["tail"] == node) & inside(e)), lambda e: e["head"])
    all_ = F.concat(heads, F.array(node))
    start, end = F.get(tokens, F.array_min(all_) - 1)["start"], F.get(tokens, F.array_max(all_) - 1)["end"]
    return F.struct(nested.alias("nested"), F.when(nested, word_at(tokens, node)).otherwise(text.substr(start + 1, end - start)).alias("wording"))


def said_edges(annotations: DataFrame) -> DataFrame:
    """Rows (sentence_id, tail, head, label, word, wording): edges with the word and the phrase at their heads, which are tokens."""

    def emit(batches):
        for batch in flat.parts(batches):
            s = flat.Sentences.of(batch)
            at = np.flatnonzero((s.head >= 1) & (s.head <= s.tokens[s.row]))
            head = s.starts()[s.row[at]] + s.head[at] - 1
            kept, es = pa.array(at), s.batch.column("edges").flatten()
            yield pa.RecordBatch.from_pydict({
                "sentence_id": s.batch.column("sentence_id").take(pa.array(s.row[at])), "tail": flat.member(es, "tail").take(kept), "head": flat.member(es, "head").take(kept),
                "label": s.label.take(kept), "word": s.words.take(pa.array(head)), "wording": s.wordings(head, *s.phrases()),
            })

    schema = annotations.select("sentence_id").schema.add("tail", "integer").add("head", "integer").add("label", "string").add("word", "string").add("wording", "string")
    return annotations.select("sentence_id", "text", "tokens", "edges").mapInArrow(emit, schema)


def associated_wordings(annotations: DataFrame, parse=iter) -> DataFrame:
    """Rows (sentence_id, node, word, nested, wording) for every token, and article if annotations have it."""
    keys = [c for c in ("sentence_id", "article") if c in annotations.columns]

    def emit(batches):
        for batch in flat.parts(parse(batches)):
            s = flat.Sentences.of(batch)
            nested, first, last = s.phrases()
            own = pa.array(np.repeat(np.arange(len(s.tokens)), s.tokens))
            said = s.wordings(np.arange(len(nested)), nested, first, last)
            yield pa.RecordBatch.from_pydict({k: s.batch.column(k).take(own) for k in keys} | {"node": flat.int32(flat.places(s.tokens) + 1), "word": s.words, "nested": pa.array(nested), "wording": said})

    schema = annotations.select(*keys).schema.add("node", T.IntegerType()).add("word", "string").add("nested", "boolean").add("wording", "string")
    return annotations.select(*keys, *(ANNOTATION if parse is iter else SENTENCE)).mapInArrow(emit, schema)


def pattern_names(words: dict[int, str], nodes: set[int], subject: int, obj: int) -> tuple[dict[int, str], list[int]]:
    """What nodes are called in a pattern, and the nodes behind the proper nouns' tags, in order."""
    names, entities, numbers = {0: ROOT_TAG, subject: SUBJECT_TAG, obj: OBJECT_TAG}, [], 0
    for n in sorted(nodes - {0, subject, obj}):
        if words[n].istitle():
            names[n] = f"{ENTITY_PREFIX}{len(entities):05d}"
            entities.append(n)
        elif words[n][:1].isdecimal():
            names[n] = f"{NUMERIC_PREFIX}{numbers:05d}"
            numbers += 1
        else:
            names[n] = words[n]
    return names, entities


def wording_hits(s: flat.Sentences, phrases: tuple, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted wording (wording, root) of all sentences in turn its sentence, and the first token whose word is the
    root and whose phrase is the wording, from 1; 0 if there is none."""
    nested, first, last = phrases
    row = np.repeat(np.arange(len(wanted)), flat.lengths(wanted))
    wanted = wanted.flatten()
    roots, wordings = (flat.plain(flat.member(wanted, c)) for c in ("root", "wording"))
    node = np.zeros(len(row), np.int64)
    coded = pa.chunked_array([s.words, roots]).combine_chunks().dictionary_encode()
    code = flat.numbers(coded.indices, -1)
    word, root, width = code[: len(s.words)], code[len(s.words) :], len(coded.dictionary) + 1
    sought = np.zeros(width, bool)
    sought[root[root >= 0]] = True
    at = np.flatnonzero(sought[word] & (word >= 0) & ~nested)
    own = np.repeat(np.arange(len(s.tokens)), s.tokens)[at]
    key = own * width + word[at]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    low, high = (np.searchsorted(key, row * width + root, side) for side in ("left", "right"))
    counts = np.where(root >= 0, high - low, 0)
    asked, token = np.repeat(np.arange(len(row)), counts), at[np.repeat(low, counts) + flat.places(counts)]
    same = pc.fill_null(pc.equal(s.wordings(token, nested, first, last), wordings.take(pa.array(asked))), False).to_numpy(zero_copy_only=False)
    asked, token = asked[same][::-1], token[same][::-1]  # the first one is written last
    node[asked] = token - s.starts()[row[asked]] + 1
    return row, node


def connected(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The patterns between subjects and objects of annotated sentences, which have their article's wordings as ``wanted``.

    Edges inside the paths from the root to both nodes, with tags for root, subject and object, numbered tags for
    proper nouns and numbers in token order, and words for the rest; equal edges merge once positions are gone.
    A pair of which a node is not reached has none. entities are what the nodes behind the proper nouns' tags say, in order."""
    s = flat.Sentences.of(batch)
    phrases = s.phrases()
    wanted = s.batch.column("wanted")
    row, node = wording_hits(s, phrases, wanted)
    found = np.flatnonzero(node)
    asked = wanted.flatten().take(pa.array(found)).to_pylist()
    pairs: dict[int, tuple[dict, dict]] = {}
    for i, n, w in zip(row[found].tolist(), node[found].tolist(), asked, strict=True):
        subjects, objects = pairs.setdefault(i, ({}, {}))
        known, key = (subjects, w["wording"]) if w["subject"] else (objects, (w["predicate"], w["wording"]))
        known[key] = min(n, known.get(key, n))
    if not pairs:
        return []
    w = flat.walks(s.row, s.tail, s.head, len(s.tokens))
    begin, start = np.searchsorted(w.row, np.arange(len(s.tokens) + 1)).tolist(), s.starts().tolist()
    number, parent, depth = w.node.tolist(), w.parent.tolist(), w.depth.tolist()
    word, label = (([*x.dictionary.to_pylist(), None], flat.numbers(x.indices, -1).tolist()) for x in (s.words.dictionary_encode(), s.label.dictionary_encode()))
    # edges by their heads, of which a path has few
    most = int(s.head.max(initial=0)) + 1
    order = np.flatnonzero(s.head >= 0)
    order = order[np.argsort((s.row * most + s.head)[order], kind="stable")]
    key, order, tail = (s.row * most + s.head)[order], order.tolist(), s.tail.tolist()
    head = s.head.tolist()

    def path(i, n):
        k = bisect.bisect_left(number, n, begin[i], begin[i + 1])
        if k == begin[i + 1] or number[k] != n or depth[k] < 0:
            return None
        nodes = {n}
        while depth[k]:
            k = parent[k]
            nodes.add(number[k])
        return nodes

    out = []
    for i, (subjects, objects) in pairs.items():
        if not subjects or not objects:
            continue
        paths = {n: path(i, n) for n in {*subjects.values(), *objects.values()}}
        for subject, a in subjects.items():
            for (predicate, obj), b in objects.items():
                if a == b or paths[a] is None or paths[b] is None:
                    continue
                nodes = paths[a] | paths[b]
                words = {n: word[0][word[1][start[i] + n - 1]] for n in nodes if n}
                names, entities = pattern_names(words, nodes, a, b)
                found = np.array([i * most + n for n in nodes])
                low, high = np.searchsorted(key, found).tolist(), np.searchsorted(key, found, "right").tolist()
                inside = [e for x, y in zip(low, high, strict=True) for e in order[x:y] if tail[e] in names]
                kept = sorted({(names[tail[e]], names[head[e]], label[0][label[1][e]]) for e in inside}, key=lambda e: (e[0], e[1], e[2] or ""))
                out.append({"row": i, "predicate": predicate, "subject_wording": subject, "object_wording": obj, "edges": [{"tail": t, "head": h, "label": x} for t, h, x in kept], "entities": [start[i] + n - 1 for n in entities], "object_is_numeric": words[b][:1].isdecimal()})
    said = sorted({n for p in out for n in p["entities"]})
    wording = dict(zip(said, s.wordings(np.array(said, np.int64), *phrases).to_pylist(), strict=True))
    kept = pa.array([p["row"] for p in out], pa.int64())
    columns = {c: s.batch.column(c).take(kept) for c in ("article", "sentence_id")}
    columns["sentence"] = s.batch.column("text").take(kept)
    kind = pa.struct([("tail", pa.string()), ("head", pa.string()), ("label", pa.string())])
    for name, values, of in (("predicate", None, pa.string()), ("subject_wording", None, pa.string()), ("object_wording", None, pa.string()), ("edges", None, pa.list_(kind)), ("entities", [[wording[n] for n in p["entities"]] for p in out], pa.list_(pa.string())), ("object_is_numeric", None, pa.bool_())):
        columns[name] = pa.array([p[name] for p in out] if values is None else values, of)
    return [pa.RecordBatch.from_pydict(columns)]


def connections(annotations: DataFrame, parse=iter) -> DataFrame:
    """Rows (article, sentence_id, sentence, predicate, subject_wording, object_wording, edges, entities, object_is_numeric) of
    annotations with ``wanted``, an array of (subject, predicate, wording, root) with subject true for what has no predicate."""

    def emit(batches):
        for batch in flat.parts(parse(batches)):
            yield from connected(batch)

    schema = annotations.select("article", "sentence_id").schema
    for name, kind in (("sentence", "string"), ("predicate", "string"), ("subject_wording", "string"), ("object_wording", "string"), ("edges", NAMED_EDGE), ("entities", "array<string>"), ("object_is_numeric", "boolean")):
        schema = schema.add(name, T._parse_datatype_string(kind))
    return annotations.select("article", "sentence_id", "wanted", *(ANNOTATION if parse is iter else SENTENCE)).mapInArrow(emit, schema)


def dot_text(name: Column, edges: Column) -> Column:
    """A pattern in the DOT language, for export."""
    lines = F.transform(edges, lambda e: F.concat(F.lit('"'), e["tail"], F.lit('" -> "'), e["head"], F.lit('" [label="'), e["label"], F.lit('"];')))
    return F.concat(F.lit('digraph "'), name, F.lit('" {\n'), F.array_join(lines, "\n"), F.lit("\n}"))


def edges_of_dot(dot: Column) -> Column:
    """The edges of ``dot_text``."""
    line = r'"([^"]*)" -> "([^"]*)" \[label="([^"]*)"\];'
    part = lambda k: F.regexp_extract_all(dot, F.lit(line), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("tail"), part(2).alias("head"), part(3).alias("label")), lambda e: F.struct(e["tail"].alias("tail"), e["head"].alias("head"), e["label"].alias("label")))
