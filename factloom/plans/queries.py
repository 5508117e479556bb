"""Queries over the star-schema tables, one or more for each operator: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import wikitext as wt
from factloom.functions.wording import English, is_numeric
from factloom.operators import corpus, depgraph, gallery, multiset, naive, sampling
from factloom.operators import triples as facts
from factloom.plans import articles, demo, harvest, match
from factloom.plans.demo import ONT, table
from factloom.sources import answers, dumps, stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EN = English()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _pages(spark, sf):
    """Documents as pages of a dump: language as prefix, one title."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang", F.col("source").alias("title"), "text")


# facts ----------------------------------------------------------------------------------------------------


@query
def triples_distinct_filtered(spark, sf):
    t = facts.without_raw_properties(facts.without_ignored(demo.triples(spark, sf)))
    return t.distinct().groupBy("p", "o_type").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query
def language_filter(spark, sf):
    return facts.in_language(demo.triples(spark, sf), "en").groupBy("p").agg(F.count("*").alias("n"))


@query
def predicate_values(spark, sf):
    return facts.values_of(demo.triples(spark, sf), ONT + "balance")


@query
def subject_labels(spark, sf):
    return facts.labels_of(demo.triples(spark, sf), ONT + "nation")


@query
def triple_labels_left_join(spark, sf):
    labels, redirects, _ = demo.names(spark, sf)
    t = facts.with_labels(facts.without_ignored(demo.triples(spark, sf)), labels, redirects, "en")
    return t.groupBy("p", "label").agg(F.count("*").alias("n"))


@query
def alternate_names(spark, sf):
    labels, redirects, _ = demo.names(spark, sf)
    return facts.alternate_names(labels, redirects, "en")


@query
def label_to_resource(spark, sf):
    labels, redirects, _ = demo.names(spark, sf)
    return facts.resolve_labels(labels.select("label"), labels, redirects, "en")


@query
def class_cascade(spark, sf):
    labels, redirects, types = demo.names(spark, sf)
    return facts.classes_of(labels.select("label"), labels, redirects, types, "en").select("label", F.array_join("classes", "|").alias("classes"))


@query
def predicates_between_labels(spark, sf):
    labels, redirects, _ = demo.names(spark, sf)
    t = demo.triples(spark, sf)
    subject = table(spark, sf, "nation").select(F.concat(F.lit("http://ex/nation/"), F.col("n_nationkey")).alias("iri"), F.col("n_name").alias("label"), F.lit("en").alias("lang"))
    # each nation with its own region and with another one
    regions = F.explode(F.array(F.col("n_regionkey"), (F.col("n_regionkey") + 1) % 5)).alias("r_regionkey")
    pairs = table(spark, sf, "nation").select("n_name", regions).join(table(spark, sf, "region"), "r_regionkey").select(F.col("n_name").alias("subject_label"), F.col("r_name").alias("object_label"))
    return facts.predicates_between(pairs, t, labels.unionByName(subject), redirects, "en")


@query
def iri_expand(spark, sf):
    iris = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("foaf:name", "rdfs:label", "dbpedia-owl:abstract", "http://x/y:z", "nope:x")])).alias("iri"))
    return iris.select("iri", tx.expand_iri(F.col("iri")).alias("expanded"))


@query
def unworded_triples(spark, sf):
    t = demo.triples(spark, sf).join(demo.worded(spark, sf).filter("wording IS NULL").select("subject", "p").distinct(), ["subject", "p"])
    return facts.unworded(t, F.lit(None).cast("string")).select("p", "n", F.size("objects").alias("objects"))


@query
def ntriples_read(spark, sf):
    """Facts written as lines of N-Triples, and read again."""
    t = demo.triples(spark, sf)
    literal = F.concat(F.lit('"'), F.col("o_value"), F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")), F.concat(F.lit("@"), F.col("o_lang")), F.lit("")))
    value = F.when(F.col("o_type") == "uri", F.concat(F.lit("<"), F.col("o_value"), F.lit(">"))).otherwise(literal)
    lines = t.select(F.concat(F.lit("<"), F.col("subject"), F.lit("> <"), F.col("p"), F.lit("> "), value, F.lit(" .")).alias("value"))
    return answers.ntriples(lines).groupBy("p", "o_type", "o_datatype", "o_lang").agg(F.count("*").alias("n"), F.min("o_value").alias("least"), F.max("o_value").alias("most"))


@query
def solutions_read(spark, sf):
    """Nations as the solutions of one stored answer of a query service for each region."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("r"), F.struct(F.struct(F.lit("uri").alias("type"), F.concat(F.lit("http://ex/"), F.col("n_nationkey")).alias("value")).alias("p"), F.struct(F.lit("literal").alias("type"), F.col("n_name").alias("value"), F.lit("en").alias("xml:lang")).alias("o")).alias("b"))
    bodies = n.groupBy("r").agg(F.to_json(F.struct(F.struct(F.collect_list("b").alias("bindings")).alias("results"))).alias("body"))
    return answers.triples_of(answers.bindings(bodies, ["p", "o"]), "http://ex/s").drop("label")


@query
def random_subjects(spark, sf):
    return sampling.random_subjects(demo.triples(spark, sf), 100, 3)


# wordings -------------------------------------------------------------------------------------------------


@query
def wording_int(spark, sf):
    return table(spark, sf, "part").select("p_partkey", EN.worded_int((F.col("p_size") * 123456 - 2000000).cast("string")).alias("worded"))


@query
def wording_float(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", EN.worded_float(F.col("c_acctbal")).alias("worded"))


@query
def wording_units(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", EN.worded_inch(s).alias("inch"), EN.worded_kilometre(s * 1000).alias("km"), EN.worded_square_kilometre(s * 1000, unit=False).alias("km2"))


@query
def wording_date(spark, sf):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", EN.worded_date(d).alias("worded"), EN.worded_date(F.concat(F.lit("-"), d)).alias("before"))


@query
def wording_dispatch(spark, sf):
    return demo.worded(spark, sf).groupBy("p").agg(F.count("*").alias("n"), F.count("wording").alias("worded"), F.min("wording").alias("least"), F.max("wording").alias("most"))


@query
def class_phrases(spark, sf):
    return table(spark, sf, "region").select("r_name", F.array_join(EN.class_phrases(F.col("r_name")), "|").alias("phrases"))


@query
def numeric_and_title_tokens(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("w")).filter("w <> ''")
    return w.groupBy("w").agg(F.count("*").alias("n")).filter(EN.part_of_proper_noun(F.col("w")) | is_numeric(F.col("w"))).select("w", "n", is_numeric(F.col("w")).alias("numeric"))


@query
def title_normalisation(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("_"))
    return p.select("p_partkey", tx.normalize_title(raw).alias("title"), tx.title_key(F.concat("p_brand", F.lit("%20"), "p_type")).alias("key"), tx.filename_safe(F.col("p_brand")).alias("file"))


@query
def article_urls(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", tx.article_url(F.lit("en"), F.col("p_name")).alias("url"), tx.curid_url(F.lit("http://en.wikipedia.org/wiki"), F.col("p_partkey")).alias("curid"))


# running text ---------------------------------------------------------------------------------------------


@query
def sentence_guard(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("s"))
    return rows.groupBy("lang").agg(F.count_if(tx.admissible(F.col("s"))).alias("taken"), F.count_if(~tx.admissible(F.col("s"))).alias("refused"))


@query
def reject_reasons(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("s"))
    return rows.groupBy("lang", tx.reject_reason(F.col("s"), 200, 8).alias("reason")).agg(F.count("*").alias("n"))


@query
def first_halves(spark, sf):
    words = F.split("text", "[ \n]+")
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(sampling.ceil_half(words), " ")).alias("digest"))


@query
def sentences_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(tx.split_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"))


@query
def adjust_dates(spark, sf):
    m = demo.markup(spark, sf)
    return m.select("page_id", EN.adjust_text(F.col("text")).alias("text"))


@query
def html_strip(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.md5(F.regexp_replace(wt.drop_comments(F.col("html")), "<[^>]+>", "")).alias("digest"))


@query
def entities_unescape_subset(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(wt.unescape_common(F.col("html"))).alias("digest"))


@query
def comments_removed(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(wt.drop_comments(F.col("html"))).alias("length"))


@query
def html_cleaned(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(wt.tidy(wt.placeholders(wt.drop_elements(wt.unescape_all(F.col("html")))))).alias("length"))


@query
def wiki_links(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.expand_links(F.col("text")).alias("text"))


@query
def wiki_bold(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.quote_marks(F.col("text")).alias("text"))


@query
def external_links(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.external_links(wt.expand_links(F.col("text"))).alias("text"))


@query
def templates_expanded(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.expand_templates(F.col("text")).alias("text"))


@query
def section_titles(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.drop_section_titles(F.col("text")).alias("text"))


@query
def nested_templates_dropped(spark, sf):
    m = demo.markup(spark, sf)
    return m.select("page_id", wt.drop_nested(F.concat(F.lit("{{a|{{b}}}}"), "text")).alias("text"))


@query
def compact_paragraphs(spark, sf):
    rows = articles.paragraph_rows(demo.markup(spark, sf).withColumn("title", F.col("page_id").cast("string")))
    return rows.select("title", "para_no", "text")


@query
def markup_removed(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.remove_markup(F.col("text")).alias("text"))


@query
def article_markup_removed(spark, sf):
    return demo.article_markup(spark, sf).select("page_id", F.md5(wt.remove_markup(F.col("text"))).alias("digest"))


@query
def article_documents(spark, sf):
    """Documents with headers, list items and links kept."""
    options = dumps.ExtractOptions(keep_sections=True, keep_links=True)
    return articles.article_documents(demo.article_markup(spark, sf), options).select("page_id", F.md5("text").alias("digest"))


@query
def prose_paragraphs(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.explode(wt.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 20)).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(wt.content_paragraph(F.col("p"))).alias("prose"))


@query
def sentence_population(spark, sf):
    pages = demo.markup(spark, sf).withColumn("title", F.col("page_id").cast("string"))
    return articles.sentence_population(pages, pages.select("title"))


# pages and categories -------------------------------------------------------------------------------------


@query
def page_categories(spark, sf):
    return demo.markup(spark, sf).select("page_id", F.array_join(wt.categories(F.col("text")), "|").alias("piped"), F.array_join(wt.categories(F.col("text"), True), "|").alias("all"))


@query
def category_index(spark, sf):
    return corpus.category_index(demo.markup(spark, sf)).select("category", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query
def category_sizes(spark, sf):
    return corpus.category_sizes(demo.markup(spark, sf))


@query
def lang_equiv(spark, sf):
    return demo.markup(spark, sf).select("page_id", wt.language_equivalent(F.col("text"), "de").alias("de"), wt.language_equivalent(F.col("text"), "fr").alias("fr"))


@query
def title_index(spark, sf):
    return corpus.first_of_title(demo.markup(spark, sf)).select("title", "page_id")


@query
def page_lookup(spark, sf):
    pages = corpus.first_of_title(demo.markup(spark, sf))
    titles = spark.createDataFrame([("red widget",)], "title string")
    return articles.article_text(pages, titles).select("title", "page_id", F.length("text").alias("length"))


@query
def article_filter(spark, sf):
    m = demo.markup(spark, sf)
    pages = m.select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("Talk:"), "title")).when(F.col("page_id") % 7 == 0, F.concat(F.lit("w:"), "title")).otherwise(F.col("title")).alias("title"), F.when(F.col("page_id") % 11 == 0, "x").alias("redirect"))
    return dumps.articles(pages).select("page_id", "title")


@query
def page_numbers(spark, sf):
    return dumps.numbered(_pages(spark, sf)).select("lang", "page_id", "ordinal")


@query
def sampled_pages(spark, sf):
    """Pages of at least 400 bytes once their markup is gone."""
    pages = demo.article_markup(spark, sf).select("page_id", "lang", "text")
    return sampling.sample_pages(pages, 20, 9, 400, clean=True).select("page_id", "lang")


@query
def dump_stats(spark, sf):
    return corpus.dump_statistics(demo.markup(spark, sf))


@query
def lang_dist(spark, sf):
    return corpus.language_distribution(_pages(spark, sf))


@query
def length_stats(spark, sf):
    return corpus.length_statistics(_pages(spark, sf)).select("lang", "median", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def length_overall(spark, sf):
    rows = corpus.overall_length_statistics(_pages(spark, sf))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query
def length_thresholds(spark, sf):
    return corpus.under_thresholds(_pages(spark, sf)).select("lang", "threshold", "under", F.round("proportion", 9).alias("proportion"))


@query
def length_histogram(spark, sf):
    return corpus.length_histogram(_pages(spark, sf))


@query
def docs_under_threshold(spark, sf):
    return corpus.documents_under(_pages(spark, sf), 1000)


# naive statistics -----------------------------------------------------------------------------------------


@query
def naive_subject_stats(spark, sf):
    kept = facts.without_ignored(demo.document_facts(spark, sf))
    return naive.subject_coverage(kept, demo.texts(spark, sf)).withColumn("ratio", F.round("ratio", 9))


@query
def naive_context_counts(spark, sf):
    kept = facts.without_ignored(demo.document_facts(spark, sf))
    return naive.context_counts(naive.context_rows(kept, demo.texts(spark, sf)))


@query
def naive_context_top5(spark, sf):
    return naive.top_contexts(naive_context_counts(spark, sf))


@query
def naive_couplings(spark, sf):
    kept = facts.without_ignored(demo.document_facts(spark, sf))
    return naive.couplings(naive.context_rows(kept, demo.texts(spark, sf)))


@query
def predicate_wordings(spark, sf):
    return naive.wordings_by_predicate(demo.document_facts(spark, sf)).select("p", F.array_join("wordings", "|").alias("wordings"))


@query
def predicate_occurrences(spark, sf):
    return naive.predicate_occurrences(facts.without_ignored(demo.document_facts(spark, sf)), demo.lines(spark, sf).select(F.col("article").alias("subject"), "sentence"))


# multisets ------------------------------------------------------------------------------------------------


def _bags(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), r"[ \n]+")).alias("w")).filter("w <> ''")
    return multiset.count(words.filter("lang = 'en'"), "w"), multiset.count(words.filter("lang = 'de'"), "w")


@query
def multiset_count(spark, sf):
    return _bags(spark, sf)[0]


@query
def multiset_add(spark, sf):
    return multiset.add(*_bags(spark, sf))


@query
def multiset_sub(spark, sf):
    return multiset.subtract(*_bags(spark, sf))


@query
def multiset_or(spark, sf):
    return multiset.union(*_bags(spark, sf))


@query
def multiset_and(spark, sf):
    return multiset.intersect(*_bags(spark, sf))


@query
def multiset_elements(spark, sf):
    rows = multiset.elements(multiset.intersect(*_bags(spark, sf)))
    return multiset.count(rows, "elem")


@query
def multiset_most_common(spark, sf):
    return multiset.most_common(_bags(spark, sf)[0], 20)


@query
def multiset_lookup(spark, sf):
    a, b = _bags(spark, sf)
    return multiset.lookup(a, b)


@query
def multiset_discard(spark, sf):
    return multiset.discard(*_bags(spark, sf))


# samples --------------------------------------------------------------------------------------------------


@query
def sample_exact_k(spark, sf):
    return sampling.exact_sample(_pages(spark, sf), "page_id", 200, 7).select("page_id", "lang")


@query
def sample_per_lang(spark, sf):
    docs = _pages(spark, sf).filter(F.octet_length("text") >= 500)
    return sampling.sample_per_group(docs, "lang", "page_id", 25, 7).select("page_id", "lang")


@query
def weighted_choice(spark, sf):
    items = corpus.language_distribution(_pages(spark, sf)).select(F.col("lang").alias("item"), F.col("pages").alias("weight"))
    return sampling.weighted_choice(items, _pages(spark, sf).select(F.col("page_id").alias("draw_id")), 11)


@query
def language_sample(spark, sf):
    return weighted_choice(spark, sf).groupBy(F.col("item").alias("lang")).agg(F.count("*").alias("n"))


@query
def partition_exact(spark, sf):
    return sampling.partition_exact(_pages(spark, sf).select("page_id"), "page_id", [3, 1, 2], 5)


@query
def partition_probabilistic(spark, sf):
    return sampling.partition_probabilistic(_pages(spark, sf).select("page_id"), "page_id", [3, 1, 2], 5)


@query
def segment_documents(spark, sf):
    items = corpus.language_distribution(_pages(spark, sf)).select(F.col("lang").alias("item"), F.col("pages").alias("weight"))
    rows = sampling.segment_documents(_pages(spark, sf), items, 200, 2, 13)
    return rows.select("docid", F.length("doc").alias("length"), F.array_join("classes", "|").alias("classes"))


# graphs, harvest, match -----------------------------------------------------------------------------------


@query
def dep_edges(spark, sf):
    return depgraph.dep_edges(demo.annotations(spark, sf)).groupBy("label", "tail").agg(F.count("*").alias("n"))


@query
def annotations_read(spark, sf):
    """Annotated sentences written as a parser's JSON, and read again."""
    again = depgraph.parse_annotations(depgraph.annotation_json(demo.annotations(spark, sf)))
    return again.select(F.col("sentence_id").cast("long").alias("sentence_id"), F.size("tokens").alias("tokens"), F.size("edges").alias("edges"))


@query
def root_paths(spark, sf):
    rows = demo.annotations(spark, sf).select("sentence_id", F.explode(depgraph.root_paths("edges")).alias("p"))
    return rows.groupBy("sentence_id").agg(F.count("*").alias("nodes"), F.max(F.size("p.path")).alias("longest"))


@query
def reached_from_root(spark, sf):
    return depgraph.reached_from_root(demo.annotations(spark, sf))


@query
def associated_wording(spark, sf):
    rows = depgraph.associated_wordings(demo.lines(spark, sf).select("sentence_id", "sentence"), depgraph.parse_sentences)
    return rows.groupBy("wording", "nested").agg(F.count("*").alias("n"))


def _harvested(spark, sf):
    sentences = demo.lines(spark, sf).select("sentence_id", "sentence", "article").join(harvest.wanted(*demo.wordings(spark, sf)), "article")
    return harvest.harvested(sentences, bits=256, parse=depgraph.parse_sentences)


@query
def harvest_patterns(spark, sf):
    return harvest.patterns_of(_harvested(spark, sf)).select("hash", "predicate", F.size("edges").alias("edges"), F.size("entities").alias("entities"), "object_is_numeric")


@query
def pattern_sources(spark, sf):
    return harvest.pattern_sources(_harvested(spark, sf)).select("pattern", "article", F.md5("sentence").alias("sentence"), "subject_wording", "object_wording")


@query
def pattern_dot(spark, sf):
    p = harvest.patterns_of(_harvested(spark, sf))
    dot = depgraph.dot_text(F.col("predicate"), F.col("edges"))
    return p.select("hash", F.md5(dot).alias("dot"), (F.size(depgraph.edges_of_dot(dot)) == F.size("edges")).alias("whole"))


@query
def pattern_steps(spark, sf):
    p = match.usable_patterns(harvest.patterns_of(_harvested(spark, sf)))
    return match.pattern_steps(p).groupBy("side", "label").agg(F.count("*").alias("n"), F.count_distinct("pattern").alias("patterns"))


def _matched(spark, sf):
    h, sentences = match.written(_harvested(spark, sf)), match.written(demo.annotations(spark, sf))
    phrases = match.edge_rows(sentences).select(F.col("wording").alias("label")).distinct()
    labels, redirects, types = demo.names(spark, sf)
    classes = match.written(facts.classes_of(phrases, labels, redirects, types, "en"))
    return match.match(sentences, harvest.patterns_of(h, classes), classes, bits=256), harvest.pattern_sources(h)


@query
def match_all(spark, sf):
    return _matched(spark, sf)[0].groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("sentence_id").alias("sentences"))


@query
def match_trivial(spark, sf):
    return match.trivial(*_matched(spark, sf)).groupBy("predicate").agg(F.count("*").alias("n"))


@query
def match_novel(spark, sf):
    return match.novel(*_matched(spark, sf)).select("hash", "pattern", "predicate", "subject_wording", "object_wording", "sentence_id")


@query
def patterns_with_sources(spark, sf):
    h = _harvested(spark, sf)
    return match.patterns_with_sources(harvest.patterns_of(h), harvest.pattern_sources(h)).select("hash", F.size("pairs").alias("pairs"))


@query
def gallery_pages(spark, sf):
    rows = gallery.patterns_per_predicate(harvest.patterns_of(_harvested(spark, sf)))
    return articles.pages_of(rows, ["predicate"], 2)


@query
def match_gallery(spark, sf):
    h = _harvested(spark, sf).withColumn("pattern", F.col("hash"))
    return gallery.match_gallery(h).select("predicate", "page", F.md5("html").alias("html"))


@query
def gallery_sources_top5(spark, sf):
    h = _harvested(spark, sf).withColumn("pattern", F.col("hash"))
    return gallery.statement_sources(h).select("subject_wording", "predicate", "object_wording", F.md5(F.array_join("sentences", "\n")).alias("sentences"), "more")


@query
def gallery_totals(spark, sf):
    return gallery.match_totals(_harvested(spark, sf).withColumn("pattern", F.col("hash")))


# sinks ----------------------------------------------------------------------------------------------------


@query
def upsert_last_writer(spark, sf):
    e = table(spark, sf, "events")
    old = stores.last_writer(e.filter("event_type <> 'purchase'"), ["user_id"], ["ts", "event_id"])
    new = stores.last_writer(e.filter("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"])
    return stores.merged(old, new, ["user_id"]).select("user_id", "event_id", "event_type")


@query
def doc_format_export(spark, sf):
    pages = _pages(spark, sf)
    rows = stores.doc_lines(pages, tx.curid_url(F.lit("http://en.wikipedia.org/wiki"), F.col("page_id")))
    return rows.select(F.md5("value").alias("digest"))


@query
def output_files(spark, sf):
    return stores.file_numbers(_pages(spark, sf), 100_000).select("page_id", "file_no", "folder")


@query
def predicate_report(spark, sf):
    kept = facts.without_ignored(demo.document_facts(spark, sf))
    rows = naive.context_rows(kept, demo.texts(spark, sf))
    return stores.predicate_pages(naive.predicate_statistics(kept, rows))
