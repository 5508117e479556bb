import bz2
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import wikitext as wt
from factloom.functions.fixed import NAMESPACES
from factloom.functions.wording import English, common_wording, source_revision, source_wiki
from factloom.operators import depgraph, flat, multiset, naive, sampling
from factloom.plans import demo, harvest, match
from factloom.sources import dumps, stores

EN, XSD, UNIT = English(), NAMESPACES["xsd"], NAMESPACES["dbpdatatype"]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("kind", "value", "datatype", "want"),
    [
        ("typed-literal", "1234567", XSD + "int", "1,234,567"), ("typed-literal", "-1234", XSD + "integer", "-1,234"), ("typed-literal", "0", XSD + "int", "0"),
        ("typed-literal", "2.5", XSD + "double", "3"), ("typed-literal", "-0.2", XSD + "float", "0"), ("typed-literal", "12.0", UNIT + "inch", "12 in"),
        ("typed-literal", "1500.4", UNIT + "squareKilometre", "1,500 km2"), ("typed-literal", "2000-02-29", XSD + "date", "February 29, 2000"),
        ("typed-literal", "0987-01-05", XSD + "date", "January 5, 987"), ("typed-literal", "-0044-03-15", XSD + "date", "March 15, 44 B.C."),
        ("typed-literal", "2001-02-30", XSD + "date", None), ("typed-literal", "1", UNIT + "Geometry", None), ("literal", "plain", None, "plain"), ("uri", "http://x", None, "label"),
    ],
)
def test_wordings(spark, kind, value, datatype, want):
    c = common_wording(F.col("kind"), F.col("value"), F.col("datatype"), F.lit("label"))
    assert one(spark, c, kind=kind, value=value, datatype=datatype) == want


def test_dates_tags_and_phrases(spark):
    assert one(spark, EN.adjust_text(F.lit("On 21 August 1999, 3 January and 4  July <b>x</b>"))) == "On August 21, 1999, January 3 and July 4 x"
    assert one(spark, EN.adjust_text(F.lit("4 July"), strict=True)) == "4 July"
    assert one(spark, EN.class_phrases(F.lit("City Hall"))) == ["The city Hall", "the city Hall"]
    words = {"New-3": True, "USA-3": False, "new": False, "D'Arc": True, "12": False}
    assert {w: one(spark, EN.part_of_proper_noun(F.lit(w))) for w in words} == words
    url = "http://de.wikipedia.org/wiki/X?oldid=42"
    assert (one(spark, source_revision(F.lit(url))), one(spark, source_wiki(F.lit(url)))) == (42, "de")


def test_templates(spark):
    calls = {"convert|5|mi": "8 km", "convert|1,000|to|2,000|km": "1,000 km", "convert|x|mi": "x", "convert|5|acre": "", "IPA|a": "a", "ipa-en|a|us|b": "/ab/", "lang|fr|mot": "mot", "lang-de|links=no|Wort": "Wort", "transl|ru|da": "da", "As of|1999": "as of 1999", "nhly|1998": "1998-1999", "other|x": "", "alone": ""}
    for call, want in calls.items():
        assert one(spark, wt.expand_templates(F.lit(f"a {{{{{call}}}}} b {{{{none|x}}}}c"))) == f"a {want} b c"


def test_markup(spark):
    assert wt.without_nested("a {{b {{c}} d}} e {{f}}", "{{", "}}") == "a  e "
    assert wt.without_nested("a {{b", "{{", "}}") == "a {{b"
    assert one(spark, wt.expand_links(F.lit("[[A|b]]s [[C]] [[File:x.png|thumb|see [[D]]]] [[w:E|e]] [[]]."))) == "bs C  e ."
    text = "{{t|{{u}}}}'''Bold''' ''it'' [http://a b c] &amp;nbsp;&eacute; <!-- no --><ref>gone</ref><b>kept</b> <math>x</math> <math>x</math>,,\n == pre\n!!!\nend"
    assert one(spark, wt.clean(F.lit(text))) == 'Bold "it" b c \xa0é kept formula_1 formula_1,\nend'
    assert wt.compact_lines("== Empty ==\n== Full ==\nline\n* item\n(all)\n{| x\n...\n=== Sub ===\n++Title++\nmore") == ["Full.", "line", "Title.", "Sub.", "more"]
    assert one(spark, wt.categories(F.lit("[[Category:A|x]] [[Kategorie:B|y]] [[Category:A|x]] [[Category:C]]"))) == ["Category:A", "Kategorie:B"]
    assert one(spark, wt.language_equivalent(F.lit("[[de:Alt]] [[de:Neu]]"), "de")) == "Neu"
    assert one(spark, wt.remove_markup(F.lit("#REDIRECT x\n\n[[de:Y]]'''A''' [[b|c]].\n\n* list\n\nkey: no\n\nLast"))) == "A c.\n\nLast\n"


def test_entities_end_with_a_semicolon(spark):
    said = {"a&amp": "a&amp", "&amp;amp</b>": "&amp</b>", "&amp;amp;": "&", "&notit; &copy 1": "&notit; &copy 1", "&eacute;&#233;&#xE9;&amp;#233;": "éééé", "&amp;lt;&nbsp;": "<\xa0", "&#12ab; &none;": "&#12ab; &none;"}
    assert {s: one(spark, wt.unescape_all(F.lit(s))) for s in said} == said


def test_running_text(spark):
    assert one(spark, tx.split_sentences(F.lit('He met Dr. No. "Yes!"He left.  Why? So'))) == ["He met Dr. No.", '"Yes!"', "He left.", "Why?", "So"]
    text = "One day the old cat, sat here. No."
    assert [tuple(x) for x in one(spark, tx.contexts(F.lit(text), F.lit("old cat")))] == [("day the", "sat here")]
    assert one(spark, tx.wording_in_text(F.lit(text), F.lit("CAT"))) and not one(spark, tx.wording_in_text(F.lit(text), F.lit("dog")))
    assert one(spark, tx.wording_in_text(F.lit("It is a.b here. "), F.lit("a.b")))
    assert not one(spark, tx.admissible(F.lit("Q"))) and not one(spark, tx.admissible(F.lit("," * 31))) and one(spark, tx.admissible(F.lit("fine")))
    assert one(spark, tx.nfkd(F.lit("ﬁ é"))) == "fi é" and one(spark, tx.ascii_fold(F.lit("Zürich"))) == "Zurich"
    assert one(spark, tx.title_key(F.lit("A_B%20C"))) == "A B C"


def bag(spark, text):
    return multiset.count(spark.createDataFrame([(c,) for c in text], "c string"), "c")


def counts(frame):
    return {r["elem"]: r["n"] for r in frame.collect()}


def test_multisets(spark):
    a, b = bag(spark, "abbb"), bag(spark, "bcc")
    assert counts(multiset.add(a, b)) == {"b": 4, "c": 2, "a": 1}
    assert counts(multiset.union(a, b)) == {"b": 3, "c": 2, "a": 1} and counts(multiset.intersect(a, b)) == {"b": 1}
    assert counts(multiset.subtract(bag(spark, "abbbc"), bag(spark, "bccd"))) == {"b": 2, "a": 1}
    assert sorted(r["elem"] for r in multiset.elements(a).collect()) == list("abbb")
    assert [r["elem"] for r in multiset.most_common(bag(spark, "abracadabra"), 3).collect()] == ["a", "b", "r"]
    back = multiset.add(multiset.subtract(a, b), multiset.intersect(a, b))
    assert counts(back) == counts(a)


def test_samples(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert sampling.exact_sample(rows, "k", 50, 1).count() == 50
    assert sampling.exact_sample(rows, "k", 50, 1).collect() == sampling.exact_sample(rows.repartition(9), "k", 50, 1).collect()
    sizes = {r["part"]: r["count"] for r in sampling.partition_exact(rows.limit(1000), "k", [1, 1, 1], 3).groupBy("part").count().collect()}
    assert sum(sizes.values()) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1


PARSE = """{"sentence_id": "s1", "text": "Ann Lee visited 3 towns in Norway",
 "dependencies": [], "originaldependencies": [
 {"rel": "root", "tail": "ROOT-0", "head": "visited-3"}, {"rel": "nsubj", "tail": "visited-3", "head": "Lee-2"}, {"rel": "nn", "tail": "Lee-2", "head": "Ann-1"},
 {"rel": "old", "tail": "visited-3", "head": "towns-5"}, {"rel": "dobj", "tail": "visited-3", "head": "towns-5"}, {"rel": "num", "tail": "towns-5", "head": "3-4"},
 {"rel": "prep", "tail": "towns-5", "head": "in-6"}, {"rel": "pobj", "tail": "in-6", "head": "Norway-7"}, {"rel": "cycle", "tail": "Norway-7", "head": "towns-5"}],
 "words": [{"word": "Ann", "CharacterOffsetBegin": "0", "CharacterOffsetEnd": "3"}, {"word": "Lee", "CharacterOffsetBegin": "4", "CharacterOffsetEnd": "7"},
 {"word": "visited", "CharacterOffsetBegin": "8", "CharacterOffsetEnd": "15"}, {"word": "3", "CharacterOffsetBegin": "16", "CharacterOffsetEnd": "17"},
 {"word": "towns", "CharacterOffsetBegin": "18", "CharacterOffsetEnd": "23"}, {"word": "in", "CharacterOffsetBegin": "24", "CharacterOffsetEnd": "26"},
 {"word": "Norway", "CharacterOffsetBegin": "27", "CharacterOffsetEnd": "33"}]}"""


def test_graphs_harvest_and_match(spark):
    raw = spark.createDataFrame([(PARSE,), (PARSE.replace('"root"', '"x"').replace("ROOT-0", "in-6"),), ("{",)], "annotation string")
    parsed = depgraph.parse_annotations(raw).withColumn("article", F.lit("Ann")).cache()
    assert parsed.count() == 1
    assert {(r["tail"], r["head"]): r["label"] for r in depgraph.dep_edges(parsed).collect()}[3, 5] == "dobj"
    paths = {p["node"]: p["path"] for p in parsed.select(depgraph.root_paths("edges").alias("p")).first()["p"]}
    assert paths[7] == [0, 3, 5, 6, 7] and len(paths) == 8
    said = {r["word"]: (r["nested"], r["wording"]) for r in depgraph.associated_wordings(parsed).collect()}
    assert said["Lee"] == (False, "Ann Lee") and said["Ann"] == (True, "Ann") and said["towns"] == (False, "3 towns")
    subjects = spark.createDataFrame([("Ann", "Ann Lee", "Lee")], "article string, wording string, root string")
    objects = spark.createDataFrame([("Ann", "visit", "Norway", "Norway"), ("Ann", "self", "Ann Lee", "Lee")], "article string, predicate string, wording string, root string")
    got = harvest.harvest(parsed, subjects, objects)
    row = got.collect()
    assert len(row) == 1 and {(e["tail"], e["head"], e["label"]) for e in row[0]["edges"]} == {("ROOT_P", "visited", "root"), ("visited", "SUBJECT_P", "nsubj"), ("visited", "towns", "dobj"), ("towns", "in", "prep"), ("in", "OBJECT_P", "pobj"), ("OBJECT_P", "towns", "cycle")}
    assert len(row[0]["hash"]) == 56
    lib, sources = harvest.patterns_of(got), harvest.pattern_sources(got)
    found = match.match(parsed, lib)
    assert [(r["subject_wording"], r["object_wording"]) for r in match.trivial(found, sources).collect()] == [("Ann Lee", "Norway")]
    other = parsed.withColumn("sentence_id", F.lit("s2")).withColumn("text", F.replace("text", F.lit("Norway"), F.lit("Sweden")))
    assert [r["object_wording"] for r in match.novel(match.match(other, lib), sources).collect()] == ["Sweden"]
    dot = depgraph.dot_text(F.lit("p"), F.col("edges"))
    assert lib.select((depgraph.edges_of_dot(dot) == F.col("edges")).alias("x")).first()["x"]
    score = match.precision_recall(found, found).first()
    assert (score["precision"], score["recall"]) == (1.0, 1.0)


def test_paths_of_many_graphs(spark):
    import random

    rng, graphs = random.Random(5), []
    for _ in range(5000):
        n = rng.randint(1, 9)
        graphs.append([(rng.randint(0, n), rng.randint(0, n), "x") for _ in range(rng.randint(0, 2 * n))])
    lost = [(0, 2, "x"), (2, None, "x"), (None, 4, "x"), (2, 5, "x")]  # ends that a parser did not name
    rows = [(i, g) for i, g in enumerate([*graphs, lost, None])]
    table = spark.createDataFrame(rows, f"sentence_id long, edges {depgraph.EDGE}")
    got = {r["sentence_id"]: r["p"] for r in table.select("sentence_id", depgraph.root_paths("edges").alias("p")).collect()}
    want = [sorted(depgraph.paths_from([{"tail": t, "head": h} for t, h, _ in g], 0).items()) for g in graphs] + [[(0, [0]), (2, [0, 2]), (5, [0, 2, 5])]]
    assert [[(p["node"], p["path"]) for p in got[i]] for i in range(len(want))] == want and got[len(want)] is None
    reached = {r["sentence_id"]: (r["nodes"], r["reached"]) for r in depgraph.reached_from_root(table).collect()}
    assert [reached[i] for i, g in enumerate(graphs)] == [(len({x for e in g for x in e[:2]}), len(want[i])) for i, g in enumerate(graphs)]
    assert reached[len(graphs)] == (5, 3) and reached[len(want)] == (None, None)


def test_json_is_read_once(spark):
    """Labels of one pair of nodes, nodes without a number, offsets that are none, and sentences without a root; the JSON is parsed in one place of the plan."""
    deps = [("root", "ROOT-0", "a-1"), ("x", "a-1", "b -2'"), ("y", "a-1", "c"), ("z", "a-1", "b-2"), ("w", "b-2", "%d-3-4")]
    parse = {"sentence_id": 7, "text": "a b", "originaldependencies": [dict(zip(("rel", "tail", "head"), d, strict=True)) for d in deps], "words": [{"word": "a", "CharacterOffsetBegin": "0", "CharacterOffsetEnd": 1}, {"word": "b", "CharacterOffsetBegin": "x"}]}
    rows = spark.createDataFrame([(json.dumps(parse),), (json.dumps(parse | {"originaldependencies": parse["originaldependencies"][1:]}),), (json.dumps(parse | {"words": None}),), ("[", ), (None,)], "annotation string")
    got = depgraph.parse_annotations(rows)
    first, bare = sorted(got.collect(), key=lambda r: r["tokens"] is None)
    assert first["sentence_id"] == "7" and [tuple(e) for e in first["edges"]] == [(0, 1, "root"), (1, None, "y"), (1, 2, "z"), (2, 4, "w")]
    assert [tuple(t) for t in first["tokens"]] == [(1, "a", 0, 1), (2, "b", None, None)] and bare["edges"] == first["edges"]
    assert got.select(F.size("edges"), F.size("tokens"))._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_wordings_meet_sentences_where_they_are(spark):
    """Tokens are not dealt out to meet wordings, a node without a number spoils nothing, and of two phrases the first counts."""
    words = "Ann saw Oslo and Oslo".split()
    tokens = [(i + 1, w, sum(len(x) + 1 for x in words[:i]), sum(len(x) + 1 for x in words[:i]) + len(w)) for i, w in enumerate(words)]
    edges = [(0, 2, "root"), (2, 1, "nsubj"), (2, 3, "dobj"), (3, 4, "cc"), (3, 5, "conj"), (2, None, "x"), (None, 4, None)]
    rows = [(a, f"s{i}", " ".join(words), tokens, edges) for i, a in enumerate(["A", "A", "B", "C"])]
    sentences = spark.createDataFrame(rows, f"article string, sentence_id string, text string, tokens {depgraph.TOKEN}, edges {depgraph.EDGE}")
    subjects = spark.createDataFrame([("A", "Ann", "Ann"), ("A", "Ann", "Ann"), ("B", "Ann", "Ann"), ("C", "Bob", "Bob")], "article string, wording string, root string")
    objects = spark.createDataFrame([("A", "p", "Oslo", "Oslo"), ("A", None, "and", "and"), ("B", "p", "saw Oslo", "Oslo"), ("C", "p", "Oslo", "Oslo")], "article string, predicate string, wording string, root string")
    got = harvest.harvest(sentences, subjects, objects)
    want = {("p", "Oslo", (("ROOT_P", "saw", "root"), ("saw", "OBJECT_P", "dobj"), ("saw", "SUBJECT_P", "nsubj"))), (None, "and", (("ENTITY_P_00000", "OBJECT_P", "cc"), ("ROOT_P", "saw", "root"), ("saw", "ENTITY_P_00000", "dobj"), ("saw", "SUBJECT_P", "nsubj")))}
    found = got.collect()
    assert sorted(r["sentence_id"] for r in found) == ["s0", "s0", "s1", "s1"] and {(r["predicate"], r["object_wording"], tuple(tuple(e) for e in r["edges"])) for r in found} == want
    assert {tuple(r["entities"]) for r in found} == {(), ("Oslo",)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("MapInArrow") == 1
    many = pa.RecordBatch.from_pydict({"x": pa.array(range(3 * flat.PART + 1))})
    assert [p.num_rows for p in flat.parts([many])] == [flat.PART] * 3 + [1]


def test_articles_of_parts_are_dealt_out(spark):
    """The file of parts is one small block, which one task would turn into articles."""
    from factloom.plans import queries

    rows = queries.compact_paragraphs(spark, "/root/testdata/sf0.01")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sentences_are_parsed_where_they_are(spark):
    """The stand-in for a parser keeps the article, so that sentences need not be read and dealt out again for it."""
    sentences = spark.createDataFrame([("s1", " Über 3  Årsta ", "A"), ("s2", " ", "B"), ("s3", None, "C")], "sentence_id string, sentence string, article string")
    row = depgraph.pseudo_parse(sentences).collect()
    assert [(r["article"], r["text"], [tuple(t) for t in r["tokens"]], [tuple(e) for e in r["edges"]]) for r in row] == [("A", "Über 3 Årsta", [(1, "Über", 0, 4), (2, "3", 5, 6), (3, "Årsta", 7, 12)], [(0, 1, "nn"), (1, 2, "num"), (1, 3, "nn")])]
    assert "Exchange" not in demo.annotations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_entities_need_classes(spark):
    edges = [("ROOT_P", "ENTITY_P_00000", "root"), ("ENTITY_P_00000", "SUBJECT_P", "a"), ("ENTITY_P_00000", "OBJECT_P", "b")]
    make = lambda classes: spark.createDataFrame([("h", "p", edges, [("X", classes)], False)], "hash string, predicate string, edges array<struct<tail:string,head:string,label:string>>, entities array<struct<wording:string,classes:array<string>>>, object_is_numeric boolean")
    sentence = spark.createDataFrame([("s", "Oslo cat dog", [(1, "Oslo", 0, 4), (2, "cat", 5, 8), (3, "dog", 9, 12)], [(0, 1, "root"), (1, 2, "a"), (1, 3, "b")])], f"sentence_id string, text string, tokens {depgraph.TOKEN}, edges {depgraph.EDGE}")
    classes = spark.createDataFrame([("Oslo", ["City", "Place"])], "label string, classes array<string>")
    assert match.match(sentence, make(["Place"]), classes).count() == 1
    assert match.match(sentence, make(["Person"]), classes).count() == 0


def test_patterns_with_entities_match_their_own_sentences(spark):
    from factloom.plans import queries

    sf = "/root/testdata/sf0.001"
    # where equal words have merged (a head with two tails), a path of the pattern may be shorter than the sentence's
    tree = F.size("edges") == F.size(F.array_distinct(F.transform("edges", lambda e: e["head"])))
    usable = match.usable_patterns(harvest.patterns_of(queries._harvested(spark, sf))).filter(tree).select("hash")
    found, sources = queries._matched(spark, sf)
    kept = sources.join(usable, sources.pattern == usable.hash).select("pattern", "subject_wording", "object_wording").distinct().cache()
    again = match.trivial(found, sources).select("pattern", "subject_wording", "object_wording").distinct()
    assert kept.count() > 100 and kept.exceptAll(again).count() == 0
    spark.catalog.clearCache()


def test_coverage_without_worded_facts(spark):
    facts = spark.createDataFrame([(1, "p", None)], "subject long, p string, wording string")
    texts = spark.createDataFrame([(1, "Some text.")], "subject long, text string")
    assert tuple(naive.subject_coverage(facts, texts).first()) == (1, 0, 0, 0, None)


def test_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>0</ns><id>{}</id>{}<revision><id>9</id><text xml:space='preserve'>{}</text></revision></page>"
    xml = "<mediawiki>" + page.format("A", 1, "", "one") + page.format("Talk:B", 2, "", "") + page.format("C", 3, "<redirect title='A'/>", "x") + "</mediawiki>"
    (tmp_path / "enwiki-20120101-pages-articles.xml").write_text(xml)
    (tmp_path / "dewiki-20120101-pages-articles.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    pages = dumps.read_dumps(spark, str(tmp_path))
    assert sorted((r["lang"], r["page_id"], r["text"]) for r in dumps.articles(pages).collect()) == [("de", 1, "one"), ("en", 1, "one")]
    assert dumps.read_dumps(spark, str(tmp_path), ["de"]).count() == 3
    assert sorted((r["lang"], r["date"]) for r in dumps.find_dumps(spark, str(tmp_path)).collect()) == [("de", "20120101"), ("en", "20120101")]
    dumps.build_index(pages, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).filter("lang = 'en' AND title = 'A'").count() == 1
    (tmp_path / "titles").write_text("A\n\nB\n")
    assert [r["title"] for r in dumps.read_titles(spark, str(tmp_path / "titles")).collect()] == ["A", "B"]


def test_upsert_and_stream(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "hash string, v int")
    stores.upsert(spark, store, rows(("a", 1), ("b", 1)), ["hash"])
    stores.upsert(spark, store, rows(("b", 2), ("c", 2)), ["hash"])
    assert sorted(map(tuple, stores.current(spark, store).collect())) == [("a", 1), ("b", 2), ("c", 2)]

    from factloom.streaming.statements import stream_statements

    raw = spark.createDataFrame([(PARSE,)], "annotation string")
    parsed = depgraph.parse_annotations(raw).withColumn("article", F.lit("Ann"))
    subjects = spark.createDataFrame([("Ann", "Ann Lee", "Lee")], "article string, wording string, root string")
    objects = spark.createDataFrame([("Ann", "visit", "Norway", "Norway")], "article string, predicate string, wording string, root string")
    got = harvest.harvest(parsed, subjects, objects)
    parsed.withColumn("text", F.replace("text", F.lit("Norway"), F.lit("Sweden"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    stream_statements(stream, harvest.patterns_of(got), harvest.pattern_sources(got), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["object_wording"] for r in stores.current(spark, str(tmp_path / "out")).collect()] == ["Sweden"]


def test_answers(spark, tmp_path):
    from factloom.sources import answers

    lines = ['<http://a> <http://p> "caf\\u00e9 \\U0001F600 \\"q\\""@fr .', '<http://a> <http://q> "5"^^<http://x#int> . # note', "_:b <http://p> <http://c> .", "not a triple", ""]
    (tmp_path / "facts.nt").write_text("\n".join(lines))
    got = {tuple(r) for r in answers.read_ntriples(spark, str(tmp_path / "facts.nt")).collect()}
    assert got == {("http://a", "http://p", "literal", 'café 😀 "q"', None, "fr"), ("http://a", "http://q", "typed-literal", "5", "http://x#int", None), ("_:b", "http://p", "uri", "http://c", None, None)}
    body = '{"results":{"bindings":[{"p":{"type":"uri","value":"http://p"},"o":{"type":"literal","value":"\\U000000e9t\\u00e9","xml:lang":"fr"}}]}}'
    asked = []

    def ask(query):
        asked.append(query)
        if len(asked) == 1:
            raise ConnectionError
        return body

    for _ in range(2):
        row = answers.triples_of(answers.bindings(answers.answer(spark, str(tmp_path / "store"), "SELECT", ask, pause=0), ["p", "o"]), "http://s").collect()
    assert [tuple(r) for r in row] == [("http://s", "http://p", "literal", "été", None, "fr", None)] and asked == ["SELECT"] * 2
    with pytest.raises(TimeoutError):
        answers.patiently(lambda: __import__("time").sleep(5), seconds=0.05, pause=0, attempts=2)
    with pytest.raises(ValueError):
        answers.patiently(lambda: int("x"), pause=0)


def test_command_line(spark, tmp_path, capsys):
    from factloom import cli

    page = "<page><title>{}</title><ns>0</ns><id>{}</id><revision><id>9</id><text xml:space='preserve'>{}</text></revision></page>"
    text = "'''Bold''' [[Ort|place]] here.\n== Part ==\n* item\nMore {{x|y}} text.\n[[Kategorie:A|*]]"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "dewiki-20120101-pages-articles.xml").write_text("<mediawiki>" + page.format("A", 1, text) + page.format("w:B", 2, "short") + page.format("Talk:C", 3, "no") + "</mediawiki>")
    run = lambda *args: cli.main([args[0], str(folder), *args[1:]], spark)
    run("list"), run("stats"), run("categories")
    shown = capsys.readouterr().out
    assert "dewiki-20120101" in shown and "de\t3\t1" in shown and "1    Kategorie:A" in shown
    run("index", str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3
    run("dataset", str(tmp_path / "set"), "-n", "1", "--minlen", "20")
    assert "Bold" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "set")).collect())
    run("extract", str(tmp_path / "plain"))
    (tmp_path / "o.ini").write_text("[extract]\nkeep_sections = yes\nprefix = http://x\nnamespaces = none\n")
    run("extract", str(tmp_path / "rich"), "--options", str(tmp_path / "o.ini"), "-k", "-c")
    read = lambda name: "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(str(tmp_path / name)).collect())
    plain, rich = read("plain"), read("rich")
    assert "Bold place here.\nPart.\nMore text." in plain.replace("  ", " ") and "short" in plain and "item" not in plain
    assert '<a href="Ort">place</a>' in rich and "<h2>Part</h2>\n<li> item</li>" in rich and "http://x?curid=1" in rich and "short" not in rich


def test_titles_by_letters(spark):
    from factloom.plans import articles

    assert one(spark, tx.ascii_fold(F.lit("Straße Øre Łódź Ænima Ёж"))) == "Strasse Ore Lodz AEnima".replace("AE", one(spark, tx.ascii_fold(F.lit("Æ")))) + " " + one(spark, tx.ascii_fold(F.lit("Ёж")))
    assert one(spark, tx.ascii_fold(F.lit("Жук"))).isascii() and one(spark, tx.ascii_fold(F.lit("Жук"))) != one(spark, tx.ascii_fold(F.lit("Зук")))
    pages = spark.createDataFrame([(1, "Zürich", "a"), (2, "Zurich", None), (3, "Bern", "c")], "page_id long, title string, text string")
    titles = spark.createDataFrame([("Zurich",), ("Zürich",)], "title string")
    assert sorted(tuple(r) for r in articles.article_text(pages, titles, fold=True).collect()) == [(1, "Zürich", "a"), (2, "Zurich", "")]
    assert articles.article_text(pages, titles).count() == 2


def test_guards_pages_and_sinks(spark, tmp_path):
    from factloom.operators import gallery

    assert [one(spark, tx.reject_reason(F.lit(s))) for s in ("Q", "x" * 1000, "," * 31, "fine")] == ["command", "too long", "too many commas", None]
    assert not one(spark, tx.admissible(F.lit("，" * 31), decompose=True)) and one(spark, tx.admissible(F.lit("，" * 31)))
    assert one(spark, tx.escape_quotes(F.lit('a "b"'))) == 'a \\"b\\"' and one(spark, sampling.ceil_half(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [1, 2]
    pages = spark.createDataFrame([(20_000, "de"), (5, "de"), (7, "en"), (6, "de")], "page_id long, lang string")
    assert {(r["lang"], r["ordinal"]): r["page_id"] for r in dumps.numbered(pages).collect()} == {("de", 0): 5, ("de", 1): 6, ("de", 2): 20_000, ("en", 0): 7}
    assert [r["page_id"] for r in dumps.page_at(pages, 1).collect()] == [6]
    for line in ("a", "b"):
        stores.append_text(spark.createDataFrame([(line,)], "s string"), "s", str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b"]
    lib = spark.createDataFrame([(f"h{i}", "p&q", [("ROOT_P", "<w>", "root")], [("X", ["c"])]) for i in range(3)], "hash string, predicate string, edges array<struct<tail:string,head:string,label:string>>, entities array<struct<wording:string,classes:array<string>>>")
    html = {r["page"]: r["html"] for r in gallery.pattern_gallery(lib, 2).collect()}
    assert html[0] == '<h1>Patterns: p&amp;q</h1><p><a href="1.html">next</a> </p><ul>' + "<li><code>ROOT_P -root-&gt; &lt;w&gt;</code> X</li>" * 2 + "</ul>" and '"0.html">previous' in html[1]
    bag_ = bag(spark, "abbb")
    assert counts(multiset.discard(bag_, spark.createDataFrame([("b",), ("z",)], "elem string"))) == {"a": 1} and [r["text"] for r in multiset.as_text(bag_).collect()] == ["b: 3", "a: 1"]


def test_store_rewrites_touched_buckets(spark, tmp_path):
    store, files = str(tmp_path / "s"), lambda: {p.parent.name + p.name for p in (tmp_path / "s").glob("data-*/_bucket=*")}
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(v).alias("v"))
    stores.upsert(spark, store, rows(0, 500, 1), ["k"])
    before = files()
    stores.upsert(spark, store, rows(3, 4, 2), ["k"])
    assert len(files() - before) == 1
    for v in range(3, 8):
        stores.upsert(spark, store, rows(0, 500, v), ["k"])
    got = stores.current(spark, store)
    assert got.count() == 500 and {r["v"] for r in got.select("v").distinct().collect()} == {7} and len(list((tmp_path / "s").glob("data-*"))) <= stores.KEPT
    with pytest.raises(Exception, match="exist"):
        stores._write_pointer(spark, store, max(stores._pointers(spark, store)), {})


def test_trees_from_files(spark, tmp_path):
    conll = "# sent_id = s1\n1\tAnn\t_\tN\t_\t_\t2\tnsubj\t_\t_\n2\tsaw\t_\tV\t_\t_\t0\troot\t_\t_\n2-3\tx\t_\t_\t_\t_\t_\t_\t_\t_\n3\tOslo\t_\tN\t_\t_\t2\tdobj\t_\t_\n\n1\tNo\t_\t_\t_\t_\t1\tdep\t_\t_\n"
    (tmp_path / "a.conllu").write_text(conll)
    got = depgraph.read_conll(spark, str(tmp_path / "a.conllu")).withColumn("article", F.lit("Ann")).collect()
    assert [(r["sentence_id"], r["text"], [tuple(e) for e in r["edges"]]) for r in got] == [("s1", "Ann saw Oslo", [(2, 1, "nsubj"), (0, 2, "root"), (2, 3, "dobj")])]
    assert [tuple(t) for t in got[0]["tokens"]] == [(1, "Ann", 0, 3), (2, "saw", 4, 7), (3, "Oslo", 8, 12)]
    rows = spark.createDataFrame(got)
    depgraph.annotation_json(rows).write.text(str(tmp_path / "json"))
    again = depgraph.read_annotations(spark, str(tmp_path / "json")).collect()
    assert sorted(tuple(e) for e in again[0]["edges"]) == sorted(tuple(e) for e in got[0]["edges"]) and again[0]["text"] == "Ann saw Oslo"


def test_naive_harvest_work_lists_and_rest(spark, tmp_path):
    from factloom.operators import corpus
    from factloom.operators import triples as facts_
    from factloom.plans import articles

    pages = spark.createDataFrame([(1, "A", "The '''old cat''' sat here.\n\nThe old cat sat there. No."), (2, "B", None)], "page_id long, title string, text string")
    facts = spark.createDataFrame([("A", "p", "old cat"), ("A", "q", "dog"), ("B", "p", "x")], "subject string, p string, wording string")
    cover, top = articles.naive_harvest(facts, pages, pages.select("title"))
    assert {r["subject"]: (r["total"], r["present"]) for r in cover.collect()} == {"A": (2, 1)}
    assert ("p", "following", "sat here", 1) in {(r["p"], r["side"], r["string"], r["n"]) for r in top.collect()}
    titles = spark.createDataFrame([(i, str(i)) for i in range(5)], "position long, title string")
    assert [r["title"] for r in articles.work_slice(titles, 1, 2).collect()] == ["1", "2"] and articles.work_slice(titles, 3).count() == 2
    assert one(spark, corpus.nearest_power_of_ten(F.lit(700.0))) == 1000.0
    assert one(spark, tx.revision_url(F.lit("en"), F.lit(7))).endswith("revids=7")
    stores.write_statistics(cover, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[0] == "Title"
    spark.createDataFrame([("a", "http://dbpedia.org/property/x"), ("b", "p")], "hash string, predicate string").write.parquet(str(tmp_path / "patterns"))
    assert [r["hash"] for r in dumps.read_patterns(spark, str(tmp_path / "patterns")).collect()] == ["b"]
    one_ = spark.createDataFrame([("s", "p", "uri", "o", None, None, None)], "subject string, p string, o_type string, o_value string, o_datatype string, o_lang string, label string")
    assert facts_.union_distinct(one_, one_).count() == 1
