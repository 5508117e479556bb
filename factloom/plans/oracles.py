"""DuckDB twins of the queries, over the same tables."""

from __future__ import annotations

from factloom.functions.fixed import CLOSED_ELEMENT, DISCARDED, EITHER_TAG, IGNORED_PREDICATES, MONTHS, NAMESPACES, RAW_PROPERTY, SELF_CLOSING, TIDY_RULES, UNWRAPPED, WHOLE_ELEMENT

ONT, RES, XSD, UNIT, RDFS, RDF = (NAMESPACES[k] for k in ("dbpedia-owl", "dbpedia", "xsd", "dbpdatatype", "rdfs", "rdf"))
IGNORED = ", ".join(f"'{p}'" for p in IGNORED_PREDICATES)


def _fact(subject, key, p, kind, value, frm, datatype=None, lang=None, label=None):
    lit = lambda x: "NULL" if x is None else f"'{x}'"
    return f"SELECT 'http://ex/{subject}/' || {key} AS subject, '{p}' AS p, '{kind}' AS o_type, CAST({value} AS VARCHAR) AS o_value, CAST({lit(datatype)} AS VARCHAR) AS o_datatype, CAST({lit(lang)} AS VARCHAR) AS o_lang, CAST({label or 'NULL'} AS VARCHAR) AS label FROM {frm}"


_C = "customer JOIN nation ON c_nationkey = n_nationkey"
_S = "supplier JOIN nation ON s_nationkey = n_nationkey"
_N = "nation JOIN region ON n_regionkey = r_regionkey"
TRIPLES = "triples AS (" + " UNION ALL ".join([
    _fact("customer", "c_custkey", RDFS + "label", "literal", "c_name", _C, lang="en"),
    _fact("customer", "c_custkey", ONT + "balance", "typed-literal", "printf('%.2f', c_acctbal)", _C, XSD + "double"),
    _fact("customer", "c_custkey", ONT + "nation", "uri", f"'{RES}' || n_name", _C, label="n_name"),
    _fact("customer", "c_custkey", RDF + "type", "uri", f"'{ONT}Customer'", _C),
    _fact("supplier", "s_suppkey", ONT + "balance", "typed-literal", "printf('%.2f', s_acctbal)", _S, XSD + "float"),
    _fact("supplier", "s_suppkey", RAW_PROPERTY + "/name", "literal", "s_name", _S, lang="de"),
    _fact("supplier", "s_suppkey", ONT + "nation", "uri", f"'{RES}' || n_name", _S, label="n_name"),
    _fact("part", "p_partkey", ONT + "size", "typed-literal", "p_size", "part", XSD + "int"),
    _fact("part", "p_partkey", ONT + "area", "typed-literal", "p_size * 1000", "part", UNIT + "squareKilometre"),
    _fact("part", "p_partkey", ONT + "width", "typed-literal", "p_size", "part", UNIT + "inch"),
    _fact("part", "p_partkey", ONT + "place", "typed-literal", "p_size", "part", UNIT + "Geometry"),
    _fact("part", "p_partkey", ONT + "kind", "literal", "p_type", "part", lang="en"),
    _fact("order", "o_orderkey", ONT + "date", "typed-literal", "strftime(o_orderdate, '%Y-%m-%d')", "orders", XSD + "date"),
    _fact("nation", "n_nationkey", ONT + "region", "uri", f"'{RES}' || r_name", _N, label="r_name"),
]) + ")"
NAMES = f"""labels AS (
  SELECT '{RES}' || n_name AS iri, n_name AS label, 'en' AS lang FROM nation UNION ALL
  SELECT '{RES}N' || n_nationkey, 'Nation ' || n_nationkey, 'en' FROM nation UNION ALL
  SELECT '{RES}N' || n_nationkey, 'Land ' || n_nationkey, 'de' FROM nation UNION ALL
  SELECT '{RES}' || r_name, r_name, 'en' FROM region),
redirects AS (SELECT '{RES}N' || n_nationkey AS from_iri, '{RES}' || n_name AS to_iri FROM nation),
types AS (
  SELECT '{RES}' || n_name AS iri, 'range' AS kind, '{ONT}Country' AS class FROM nation WHERE n_nationkey % 2 = 0 UNION ALL
  SELECT '{RES}' || n_name, 'type', '{ONT}Place' FROM nation WHERE n_nationkey % 3 = 0),
known AS (
  SELECT iri, label FROM labels WHERE lang = 'en' UNION
  SELECT to_iri, label FROM redirects JOIN labels ON from_iri = iri WHERE lang = 'en')"""
INT = lambda x: f"format('{{:,}}', CAST({x} AS BIGINT))"
FLOAT = lambda x: INT(f"round(CAST({x} AS DOUBLE))")
DATE = lambda x: f"strftime(CAST({x} AS DATE), '%B %-d, %Y')"
WORDED = f"""worded AS (SELECT subject, p, o_value, CASE
  WHEN o_type = 'uri' THEN label WHEN o_type = 'literal' THEN o_value
  WHEN o_datatype = '{XSD}date' THEN {DATE("CASE WHEN o_datatype LIKE '%#date' THEN o_value END")}
  WHEN o_datatype IN ('{XSD}int', '{XSD}integer') THEN {INT("CASE WHEN o_datatype LIKE '%#int' THEN o_value END")}
  WHEN o_datatype IN ('{XSD}float', '{XSD}double') THEN {FLOAT("CASE WHEN o_datatype LIKE '%#float' OR o_datatype LIKE '%#double' THEN o_value END")}
  WHEN o_datatype = '{UNIT}squareKilometre' THEN {FLOAT("CASE WHEN o_datatype LIKE '%Kilometre' THEN o_value END")} || ' km2'
  WHEN o_datatype = '{UNIT}inch' THEN {FLOAT("CASE WHEN o_datatype LIKE '%inch' THEN o_value END")} || ' in' END AS wording FROM triples)"""
_LANGS = ("en", "fr", "de", "es")


def _by_lang(*words):
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in zip(_LANGS, words, strict=True)) + " END"


FACTS = f"""facts AS (
  SELECT doc_id AS subject, '{ONT}article' AS p, {_by_lang("the", "la", "der", "el")} AS wording FROM documents UNION ALL
  SELECT doc_id, '{ONT}link', {_by_lang("of", "de", "und", "de")} FROM documents UNION ALL
  SELECT doc_id, '{ONT}join', {_by_lang("and", "et", "die", "que")} FROM documents UNION ALL
  SELECT doc_id, '{ONT}absent', 'Nowhere' FROM documents UNION ALL
  SELECT doc_id, '{RDFS}comment', 'the' FROM documents UNION ALL
  SELECT doc_id, '{ONT}mute', NULL FROM documents)"""
_WORD = "(?:''|\\s)[A-z0-9_\\-()\"%]+[;,:]?"


def _context(n):
    run = f"((?:{_WORD}){{0,{n}}})"
    return f"'(?i)(?:(?:^|\\.)[^.]*?{run}\\s' || wording || '[;,:]?{run}(?:\\s[^.]*?)?\\.(?:[^\\d]|$))'"


CONTEXTS = f"""{FACTS}, found AS (
  SELECT p, wording, regexp_extract_all(text, {_context(3)}, 1) AS a, regexp_extract_all(text, {_context(3)}, 2) AS b
  FROM facts JOIN documents ON subject = doc_id WHERE wording IS NOT NULL AND p NOT IN ({IGNORED}) AND contains(lower(text), lower(wording))),
rows AS (SELECT p, trim(x.a, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS preceding, trim(x.b, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS following
  FROM (SELECT p, unnest(list_transform(range(1, len(a) + 1), lambda i: {{'a': a[i], 'b': b[i]}})) AS x FROM found)),
counts AS (SELECT p, side, string, count(*) AS n FROM (
  SELECT p, 'preceding' AS side, preceding AS string FROM rows UNION ALL SELECT p, 'following', following FROM rows) GROUP BY ALL)"""
WORDS = "words AS (SELECT lang, w FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS w FROM documents) WHERE w <> '')"
BAGS = WORDS + ", a AS (SELECT w AS elem, count(*) AS n FROM words WHERE lang = 'en' GROUP BY w), b AS (SELECT w AS elem, count(*) AS n FROM words WHERE lang = 'de' GROUP BY w), both_ AS (SELECT elem, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (elem))"
MARKUP = """markup AS (SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'de' ELSE 'en' END AS lang, p_name AS title,
  '{{convert|' || p_size || '|mi}} and {{convert|' || p_size || '|sqmi}}, {{lang|fr|' || p_name || '}} {{as of|1999}} {{nhly|1998}} {{unknown|x}}' || chr(10)
  || '[[Region:X]] [[' || n_name || '|link]]s [[' || n_name || ']] ''''''' || p_name || ''''''' [http://a.org/x the site] ''''italic''''' || chr(10)
  || '== Size ==' || chr(10) || 'Built on 21 August 1999 and 3 January <b>x</b>.' || chr(10)
  || '[[Category:' || p_brand || '|*]] [[Category:' || p_type || '|*]] [[Category:Bare]] [[de:' || p_name || ']]' AS text, p_brand, p_type, p_size, n_name
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"""
TITLE = "regexp_matches(w, '^[^\\p{L}]*\\p{Lu}\\p{Ll}*([^\\p{L}]+\\p{Lu}\\p{Ll}*)*[^\\p{L}]*$')"
_ADMIT = "lower(s) NOT IN ('q', 'eof') AND length(s) < 1000 AND length(regexp_replace(s, '[^,]', '', 'g')) <= 30"
LINES = f"""lines AS (SELECT doc_id AS article, lang, doc_id * 1000000000 + k - 1 AS sentence_id, s FROM (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
  WHERE {_ADMIT} AND trim(s, ' ') <> '')"""
TOKENS = f"""{LINES}, tok AS (SELECT article, sentence_id, i, w,
  CASE WHEN regexp_matches(w, '^\\p{{Nd}}') THEN 'num' WHEN {TITLE} AND regexp_matches(w, '\\p{{L}}') THEN 'nn' ELSE 'dep' END AS lab
  FROM (SELECT article, sentence_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT article, sentence_id, list_filter(string_split(s, ' '), lambda x: x <> '') AS ws FROM lines))),
kids AS (SELECT sentence_id, i // 2 AS i, max(i) AS last FROM tok WHERE lab IN ('nn', 'num') GROUP BY ALL),
sp AS (SELECT t.*, lab IN ('nn', 'num') AND t.i > 1 AS nested, coalesce(k.last, t.i) AS last FROM tok t LEFT JOIN kids k ON t.sentence_id = k.sentence_id AND t.i = k.i),
phr AS (SELECT sp.sentence_id, any_value(sp.article) AS article, sp.i, any_value(sp.w) AS w, any_value(sp.nested) AS nested,
  CASE WHEN any_value(sp.nested) THEN any_value(sp.w) ELSE string_agg(t.w, ' ' ORDER BY t.i) END AS wording
  FROM sp JOIN tok t ON t.sentence_id = sp.sentence_id AND t.i BETWEEN sp.i AND sp.last GROUP BY sp.sentence_id, sp.i)"""
HARVEST = f"""{TOKENS}, {FACTS},
hits AS (SELECT sentence_id, article, p, wording, min(i) AS i FROM phr JOIN (SELECT subject, p, wording AS wd FROM facts WHERE wording IS NOT NULL AND p LIKE '{ONT}%') ON article = subject AND wording = wd AND w = wd WHERE NOT nested GROUP BY ALL),
pairs AS (SELECT s.sentence_id, s.article, o.p AS predicate, s.wording AS subject_wording, o.wording AS object_wording, s.i AS s, o.i AS o
  FROM hits s JOIN hits o ON s.sentence_id = o.sentence_id AND s.p = '{ONT}article' AND o.p <> '{ONT}article' AND s.i <> o.i),
nodes AS (SELECT DISTINCT pairs.*, x >> k AS n FROM pairs, (SELECT unnest([1, 2]) AS which), (SELECT unnest(range(0, 13)) AS k), LATERAL (SELECT CASE which WHEN 1 THEN s ELSE o END AS x) WHERE x >> k > 0),
kinds AS (SELECT nodes.*, w, lab, CASE WHEN n = s THEN 'S' WHEN n = o THEN 'O' WHEN lab = 'nn' OR ({TITLE} AND regexp_matches(w, '\\p{{L}}')) THEN 'E' WHEN lab = 'num' THEN 'N' ELSE 'W' END AS kind
  FROM nodes JOIN tok ON tok.sentence_id = nodes.sentence_id AND tok.i = n),
named AS (SELECT *, CASE kind WHEN 'S' THEN 'SUBJECT_P' WHEN 'O' THEN 'OBJECT_P' WHEN 'W' THEN w
  ELSE CASE kind WHEN 'E' THEN 'ENTITY_P_' ELSE 'NUMERIC_P_' END || lpad(CAST(row_number() OVER (PARTITION BY sentence_id, predicate, s, o, kind ORDER BY n) - 1 AS VARCHAR), 5, '0') END AS name FROM kinds),
edges AS (SELECT DISTINCT c.sentence_id, c.article, c.predicate, c.subject_wording, c.object_wording, c.s, c.o, coalesce(t.name, 'ROOT_P') AS tail, c.name AS head, c.lab AS label
  FROM named c LEFT JOIN named t ON t.sentence_id = c.sentence_id AND t.predicate = c.predicate AND t.s = c.s AND t.o = c.o AND t.n = c.n // 2),
harvested AS (SELECT sentence_id, article, predicate, subject_wording, object_wording, o, count(*) AS n_edges,
  sha256(predicate || chr(10) || string_agg(tail || '|' || label || '|' || head, chr(10) ORDER BY tail || '|' || label || '|' || head)) AS hash FROM edges GROUP BY sentence_id, article, predicate, subject_wording, object_wording, o),
full_ AS (SELECT h.*, array_to_string(list_filter(string_split(s, ' '), lambda x: x <> ''), ' ') AS sentence FROM harvested h JOIN lines l ON l.sentence_id = h.sentence_id)"""
STEPS = """e AS (SELECT DISTINCT h.hash, tail, head, label FROM edges e JOIN harvested h ON h.sentence_id = e.sentence_id AND h.predicate = e.predicate AND h.subject_wording = e.subject_wording AND h.object_wording = e.object_wording AND h.o = e.o),
usable AS (SELECT hash FROM e GROUP BY hash HAVING bool_or(head NOT IN ('SUBJECT_P', 'OBJECT_P', 'ROOT_P') OR tail NOT IN ('SUBJECT_P', 'OBJECT_P', 'ROOT_P'))),
labels AS (SELECT hash, tail, head, min(label) AS label FROM e JOIN usable USING (hash) GROUP BY ALL),
walks AS (SELECT hash, 'ROOT_P' AS node, ['ROOT_P'] AS path FROM usable UNION ALL
  SELECT walks.hash, head, list_append(path, head) FROM walks JOIN labels ON labels.hash = walks.hash AND tail = node WHERE NOT list_contains(path, head)),
ends AS (SELECT hash, node, path FROM (SELECT *, row_number() OVER (PARTITION BY hash, node ORDER BY len(path), path) AS r FROM walks WHERE node IN ('SUBJECT_P', 'OBJECT_P')) WHERE r = 1),
both_ AS (SELECT hash FROM ends GROUP BY hash HAVING count(*) = 2),
steps AS (SELECT hash, CASE node WHEN 'SUBJECT_P' THEN 'subject' ELSE 'object' END AS side, i, path[i] AS tail, path[i + 1] AS head FROM (SELECT *, unnest(range(1, len(path))) AS i FROM ends JOIN both_ USING (hash)))"""
# Sentences' paths from the root, by labels, and the patterns' steps that they fit; no object of these harvests is a number, and no phrase has a known class.
MATCHED = """ways AS (SELECT hash, side, string_agg(label, '|' ORDER BY i) AS labels, list(CASE WHEN head = 'SUBJECT_P' THEN 'S' WHEN head = 'OBJECT_P' THEN 'O' WHEN starts_with(head, 'ENTITY_P_') THEN 'E' WHEN starts_with(head, 'NUMERIC_P_') THEN 'N' ELSE 'W' || head END ORDER BY i) AS keys
  FROM steps JOIN labels USING (hash, tail, head) GROUP BY hash, side),
kinds_ AS (SELECT sentence_id, i, lab, w, CASE WHEN regexp_matches(w, '^\\p{Nd}') THEN 'N' WHEN __TITLE__ AND regexp_matches(w, '\\p{L}') THEN 'E' ELSE '' END AS kind FROM tok),
trails AS (SELECT t.sentence_id, t.i, string_agg(a.lab, '|' ORDER BY a.i) AS labels, list(a.w ORDER BY a.i) AS ws, list(a.kind ORDER BY a.i) AS ks
  FROM (SELECT sentence_id, i, unnest(range(0, 13)) AS k FROM tok) t JOIN kinds_ a ON a.sentence_id = t.sentence_id AND a.i = t.i >> t.k AND t.i >> t.k > 0 GROUP BY ALL),
named_ AS (SELECT *, CASE WHEN p > 0 THEN substr(keys[p], 2) ELSE '' END AS word FROM (SELECT *, coalesce(list_position(list_transform(keys, lambda k: k[1]), 'W'), 0) AS p FROM (SELECT DISTINCT keys, labels FROM ways))),
placed AS (SELECT *, CASE WHEN p > 0 THEN ws[p] ELSE '' END AS word FROM (SELECT *, unnest(range(0, len(ws) + 1)) AS p FROM trails)),
fits AS (SELECT keys, labels, sentence_id, i FROM named_ JOIN placed USING (labels, p, word)
  WHERE len(list_filter(range(1, len(keys) + 1), lambda j: NOT CASE keys[j][1] WHEN 'S' THEN true WHEN 'O' THEN ks[j] <> 'N' WHEN 'E' THEN ks[j] = 'E' WHEN 'N' THEN ks[j] = 'N' ELSE keys[j] = 'W' || ws[j] END)) = 0),
two AS (SELECT a.hash AS pattern, a.keys AS sk, a.labels AS sl, b.keys AS ok, b.labels AS ol FROM ways a JOIN ways b ON a.hash = b.hash AND a.side = 'subject' AND b.side = 'object'),
ends_ AS (SELECT DISTINCT two.pattern, s.sentence_id, s.i AS s, o.i AS o FROM two JOIN fits s ON s.keys = sk AND s.labels = sl JOIN fits o ON o.keys = ok AND o.labels = ol AND o.sentence_id = s.sentence_id AND o.i <> s.i),
matched AS (SELECT DISTINCT pattern, predicate, p.wording AS subject_wording, q.wording AS object_wording, e.sentence_id
  FROM ends_ e JOIN (SELECT DISTINCT hash, predicate FROM harvested) h ON h.hash = pattern JOIN phr p ON p.sentence_id = e.sentence_id AND p.i = e.s JOIN phr q ON q.sentence_id = e.sentence_id AND q.i = e.o)""".replace("__TITLE__", TITLE)
_PAGES = "(SELECT doc_id AS page_id, lang, source AS title, text, octet_length(encode(text)) AS bytes FROM documents)"
_DRAW = lambda key, seed: f"md5('{seed}:' || {key})"
_U = lambda key, seed: f"CAST(('0x' || substr({_DRAW(key, seed)}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
_CHOICE = f"""w AS (SELECT lang AS item, count(*) AS weight FROM documents GROUP BY lang),
cdf AS (SELECT item, (sum(CAST(weight AS DOUBLE)) OVER (ORDER BY item) - weight) / sum(CAST(weight AS DOUBLE)) OVER () AS low, sum(CAST(weight AS DOUBLE)) OVER (ORDER BY item) / sum(CAST(weight AS DOUBLE)) OVER () AS high FROM w),
chosen AS (SELECT doc_id AS draw_id, item FROM (SELECT doc_id, {_U("doc_id", 11)} AS u FROM documents) JOIN cdf ON u >= low AND u < high)"""
_LINE1 = lambda end: f"{FLOAT('p_size * 1.609344')} || ' km and ' || {FLOAT('p_size * 2.589988110336')} || ' km2, ' || title || ' as of 1999 1998-1999{end}'"
# documents in wiki markup, as demo.article_markup makes them
_FIRST, _REST = "split_part(s, ' ', 1)", "substr(s, length(split_part(s, ' ', 1)) + 1)"
ARTICLES = f"""dressed AS (SELECT doc_id, lang, source, i, CASE i % 7
    WHEN 0 THEN repeat(chr(39), 3) || {_FIRST} || repeat(chr(39), 3) || {_REST} WHEN 1 THEN '[[Page of|' || {_FIRST} || ']]' || {_REST}
    WHEN 2 THEN '{{{{note|x}}}}' || {_FIRST} || '<!-- no -->' || {_REST} WHEN 3 THEN '* ' || s WHEN 4 THEN repeat(chr(39), 2) || {_FIRST} || repeat(chr(39), 2) || {_REST}
    WHEN 5 THEN '== Part ==' || chr(10) || s ELSE 'key: ' || {_FIRST} || ' <math>x</math>' || {_REST} END AS s
  FROM (SELECT doc_id, lang, source, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))),
articles AS (SELECT doc_id AS page_id, lang, source AS title, string_agg(s, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || '[[de:Seite]]' AS text FROM dressed GROUP BY ALL)"""


def _replaced(x, *rules):
    """x after each (pattern, replacement), everywhere."""
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return x


_SPACES = r"^\s+|\s+$"
_ONE = "'\\1'"
#: Three or two apostrophes on either side, each doubled inside a literal.
_BOLD, _ITALIC = (2 * k * chr(39) + "(.*?)" + 2 * k * chr(39) for k in (3, 2))
BARE = f"""bare AS (SELECT page_id, lang, {_replaced("text", ("#REDIRECT .*", "''"), (r"\[\[[a-z]{2,3}(?:-[a-z]+)*:.+?\]\]", "''"), (r"\{\{.*?\}\}", "''"), (r"\[\[(?:[^\]]*?\|)?(.*?)\]\]", _ONE), (chr(92) + "n" + chr(92) + "n+", "chr(10) || chr(10)"), (_SPACES, "''"))} AS t FROM articles),
paragraphs AS (SELECT page_id, lang, i, {_replaced("p", ("\\s", "' '"))} AS p FROM (SELECT page_id, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT page_id, lang, string_split(t, chr(10) || chr(10)) AS ps FROM bare))),
prose AS (SELECT page_id, lang, i, trim({_replaced("p", (_BOLD, _ONE), (_ITALIC, _ONE))}, ' ') AS p FROM paragraphs WHERE __PROSE__),
cleaned AS (SELECT page_id, any_value(lang) AS lang, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i), '') || chr(10) AS text FROM (SELECT articles.page_id, articles.lang, i, p FROM articles LEFT JOIN prose USING (page_id)) GROUP BY page_id)"""
_DATES = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '(\\d{{1,2}})\\s+({'|'.join(MONTHS)})\\s+(\\d{{2,4}})', '\\2 \\1, \\3', 'g'), '(\\d{{1,2}})\\s+({'|'.join(MONTHS)})', '\\2 \\1', 'g'), '<[^>]+>', '', 'g')"
_COMMENTS = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
_KEYWORDS = "Category|Catégorie|Kategorie|Categoria|Категория|Kategoria|Categorie|Kategori"

_PROSE = f"NOT (regexp_matches(p, '^[\\p{{L}}\\p{{N}}_-]+:') OR regexp_matches(p, '^[\\p{{L}}\\p{{N}}_]+=') OR regexp_matches(p, '[|{{}}*#<(:;]|==') OR regexp_matches(p, '(?:{_KEYWORDS}):.+'))"
BARE = BARE.replace("__PROSE__", _PROSE)
_ENTITIES = lambda x: f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_HTML = _replaced(
    _ENTITIES(_ENTITIES("html")), ("(?s)<!--.*?-->", "''"), (CLOSED_ELEMENT.format("|".join(SELF_CLOSING)), "''"), (EITHER_TAG.format("|".join(UNWRAPPED)), "''"), *[(WHOLE_ELEMENT.format(t), "''") for t in DISCARDED],
    *[(p, {"": "''", "\n": "chr(10)"}.get(n, f"'{n}'")) for p, n in TIDY_RULES],
)
# twice, as a match takes the character before it and the space after it; letters of any script make a word longer
_ABBREVIATION = (r"(^|[^\p{L}\p{N}_])(Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|e\.g|i\.e|[A-Z])\.(\s)", "'\\1\\2' || chr(1) || '\\3'")
_SENTENCES = _replaced("text", (r'([.!?])"(\S)', "'\\1\" \\2'"), _ABBREVIATION, _ABBREVIATION, (r'([.!?]"?)\s+', "'\\1' || chr(2)"))
_CELL = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ORACLES: dict[str, str] = {
    "ntriples_read": f"WITH {TRIPLES} SELECT p, o_type, o_datatype, o_lang, count(*) AS n, min(o_value) AS least, max(o_value) AS most FROM triples GROUP BY ALL",
    "solutions_read": "SELECT 'http://ex/s' AS subject, 'http://ex/' || n_nationkey AS p, 'literal' AS o_type, n_name AS o_value, CAST(NULL AS VARCHAR) AS o_datatype, 'en' AS o_lang FROM nation",
    "random_subjects": f"WITH {TRIPLES} SELECT subject FROM (SELECT DISTINCT subject FROM triples) ORDER BY md5('3:' || subject), subject LIMIT 100",
    "reject_reasons": "SELECT lang, CASE WHEN lower(s) IN ('q', 'eof') THEN 'command' WHEN length(s) >= 200 THEN 'too long' WHEN length(regexp_replace(s, '[^,]', '', 'g')) > 8 THEN 'too many commas' END AS reason, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY ALL",
    "first_halves": "SELECT doc_id, md5(array_to_string(w[1 : (len(w) + 1) // 2], ' ')) AS digest FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents)",
    "page_numbers": "SELECT lang, doc_id AS page_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal FROM documents",
    "sampled_pages": f"WITH {ARTICLES}, {BARE} SELECT page_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW('page_id', 9)}, page_id) AS r FROM cleaned WHERE octet_length(encode(text)) >= 400) WHERE r <= 20",
    "article_markup_removed": f"WITH {ARTICLES}, {BARE} SELECT page_id, md5(text) AS digest FROM cleaned",
    "markup_removed": f"WITH {MARKUP} SELECT page_id, chr(10) AS text FROM markup",
    "multiset_discard": f"WITH {BAGS} SELECT * FROM a WHERE elem NOT IN (SELECT elem FROM b)",
    "annotations_read": f"WITH {TOKENS} SELECT sentence_id, count(*) AS tokens, count(*) AS edges FROM tok GROUP BY sentence_id",
    "compact_paragraphs": f"WITH {MARKUP} SELECT CAST(page_id AS VARCHAR) AS title, k AS para_no, CASE k WHEN 1 THEN {_LINE1(' ')} WHEN 2 THEN 'Size.' ELSE 'Built on 21 August 1999 and 3 January x.' END AS text FROM markup, (SELECT unnest([1, 2, 3]) AS k)",
    "sentence_population": f"WITH {MARKUP} SELECT CAST(page_id AS VARCHAR) AS title, k AS para_no, 1 AS sent_no, CASE k WHEN 1 THEN {_LINE1('')} WHEN 2 THEN 'Size.' ELSE 'Built on August 21, 1999 and January 3 x.' END AS sentence FROM markup, (SELECT unnest([1, 2, 3]) AS k)",
    "nested_templates_dropped": f"WITH {MARKUP} SELECT page_id, regexp_replace(text, '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g') AS text FROM markup",
    "html_cleaned": f"SELECT page_id, length({_HTML}) AS length FROM pages",
    "prose_paragraphs": f"SELECT doc_id, count(*) AS n, count(*) FILTER ({_PROSE}) AS prose FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE length(p) > 20 GROUP BY doc_id",
    "sentences_split": f"SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(string_split({_SENTENCES}, chr(2))), ' ') AS s FROM documents) WHERE s <> '' GROUP BY doc_id",
    "predicate_report": f"""WITH {CONTEXTS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY n DESC, string) AS rank FROM counts) WHERE rank <= 5),
      cells AS (SELECT p, string_agg('<tr><td>' || side || '</td><td>' || {_CELL("string")} || '</td><td>' || n || '</td></tr>', '' ORDER BY side, rank) AS c FROM top GROUP BY p),
      tables AS (SELECT p, '<h2>' || {_CELL("p")} || '</h2><table>' || coalesce(c, '') || '</table>' AS t, row_number() OVER (ORDER BY p) - 1 AS k FROM (SELECT DISTINCT p FROM facts WHERE wording IS NOT NULL AND p NOT IN ({IGNORED})) LEFT JOIN cells USING (p))
      SELECT k // 10 AS page, string_agg(t, chr(10) ORDER BY k) AS html FROM tables GROUP BY page""",
    "segment_documents": f"""WITH w AS (SELECT lang AS item, count(*) AS weight FROM documents GROUP BY lang),
      cdf AS (SELECT item, (sum(CAST(weight AS DOUBLE)) OVER (ORDER BY item) - weight) / sum(CAST(weight AS DOUBLE)) OVER () AS low, sum(CAST(weight AS DOUBLE)) OVER (ORDER BY item) / sum(CAST(weight AS DOUBLE)) OVER () AS high FROM w),
      slots AS (SELECT id, item AS lang, row_number() OVER (PARTITION BY item ORDER BY id) AS turn FROM (SELECT id, {_U("id", 13)} AS u FROM (SELECT unnest(range(400)) AS id)) JOIN cdf ON u >= low AND u < high),
      supply AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW("doc_id", 13)}, doc_id) AS turn FROM documents),
      parts AS (SELECT id // 2 AS doc, id % 2 AS k, doc_id, lang, substr(text, CAST(length(text) * (id % 2) // 2 AS INT) + 1, CAST(length(text) * (id % 2 + 1) // 2 - length(text) * (id % 2) // 2 AS INT)) AS piece FROM slots JOIN supply USING (lang, turn))
      SELECT string_agg(CAST(doc_id AS VARCHAR), '-' ORDER BY k) AS docid, length(string_agg(piece, '' ORDER BY k)) AS length, string_agg(lang, '|' ORDER BY k) AS classes FROM parts GROUP BY doc HAVING count(*) = 2""",
    "pattern_dot": f"""WITH {HARVEST}, e AS (SELECT DISTINCT h.hash, e.predicate, tail, head, label FROM edges e JOIN harvested h ON h.sentence_id = e.sentence_id AND h.predicate = e.predicate AND h.subject_wording = e.subject_wording AND h.object_wording = e.object_wording AND h.o = e.o)
      SELECT hash, md5('digraph "' || predicate || '" {{' || chr(10) || string_agg('"' || tail || '" -> "' || head || '" [label="' || label || '"];', chr(10) ORDER BY tail, head, label) || chr(10) || '}}') AS dot, NOT bool_or(contains(tail || head, '"')) AS whole FROM e GROUP BY hash, predicate""",
    "pattern_steps": f"WITH RECURSIVE {HARVEST}, {STEPS} SELECT side, label, count(*) AS n, count(DISTINCT hash) AS patterns FROM steps JOIN labels USING (hash, tail, head) GROUP BY ALL",
    "match_all": f"WITH RECURSIVE {HARVEST}, {STEPS}, {MATCHED} SELECT predicate, count(*) AS n, count(DISTINCT sentence_id) AS sentences FROM matched GROUP BY predicate",
    "match_trivial": f"WITH RECURSIVE {HARVEST}, {STEPS}, {MATCHED} SELECT predicate, count(*) AS n FROM matched SEMI JOIN harvested ON hash = pattern AND harvested.subject_wording = matched.subject_wording AND harvested.object_wording = matched.object_wording GROUP BY predicate",
    "match_novel": f"WITH RECURSIVE {HARVEST}, {STEPS}, {MATCHED} SELECT sha256('(' || subject_wording || ',' || predicate || ',' || object_wording || ')') AS hash, pattern, predicate, subject_wording, object_wording, sentence_id FROM matched ANTI JOIN harvested ON harvested.hash = pattern AND harvested.subject_wording = matched.subject_wording AND harvested.object_wording = matched.object_wording",
    "match_gallery": f"""WITH {HARVEST}, d AS (SELECT DISTINCT subject_wording, predicate, object_wording, sentence FROM full_), r AS (SELECT *, row_number() OVER (PARTITION BY subject_wording, predicate, object_wording ORDER BY sentence) AS r FROM d),
      s AS (SELECT subject_wording, predicate, object_wording, string_agg('<q>' || {_CELL("sentence")} || '</q>', ' ' ORDER BY sentence) FILTER (r <= 5) AS said, greatest(count(*) - 5, 0) AS more FROM r GROUP BY ALL),
      i AS (SELECT predicate, row_number() OVER (PARTITION BY predicate ORDER BY subject_wording, object_wording) - 1 AS k, '<li>' || {_CELL("subject_wording")} || ' – ' || {_CELL("object_wording")} || ': ' || replace(said, '"', '&quot;') || CASE WHEN more > 0 THEN ' and ' || more || ' more' ELSE '' END || '</li>' AS html FROM s),
      g AS (SELECT predicate, k // 10 AS page, string_agg(html, '' ORDER BY k) AS items FROM i GROUP BY ALL)
      SELECT predicate, page, md5('<h1>Statements: ' || {_CELL("predicate")} || '</h1><p>' || CASE WHEN page > 0 THEN '<a href="' || (page - 1) || '.html">previous</a> ' ELSE '' END || CASE WHEN page < max(page) OVER (PARTITION BY predicate) THEN '<a href="' || (page + 1) || '.html">next</a> ' ELSE '' END || '</p><ul>' || items || '</ul>') AS html FROM g""",
    "triples_distinct_filtered": f"WITH {TRIPLES} SELECT p, o_type, count(*) AS n, count(DISTINCT subject) AS subjects FROM (SELECT DISTINCT * FROM triples WHERE p NOT IN ({IGNORED}) AND NOT starts_with(p, '{RAW_PROPERTY}')) GROUP BY ALL",
    "language_filter": f"WITH {TRIPLES} SELECT p, count(*) AS n FROM triples WHERE coalesce(lower(o_lang) IN ('en', '') OR starts_with(lower(o_lang), 'en-'), false) OR o_type = 'uri' OR (o_datatype IS NOT NULL AND o_datatype <> '{XSD}string') GROUP BY p",
    "predicate_values": f"WITH {TRIPLES} SELECT DISTINCT subject, o_value FROM triples WHERE p = '{ONT}balance'",
    "subject_labels": f"WITH {TRIPLES} SELECT DISTINCT subject, label FROM triples WHERE p = '{ONT}nation' AND label IS NOT NULL",
    "triple_labels_left_join": f"WITH {TRIPLES}, {NAMES}, j AS (SELECT DISTINCT t.* EXCLUDE (label), known.label FROM triples t LEFT JOIN known ON known.iri = o_value WHERE p NOT IN ({IGNORED})) SELECT p, label, count(*) AS n FROM j GROUP BY ALL",
    "alternate_names": f"WITH {NAMES} SELECT DISTINCT to_iri AS iri, label FROM redirects JOIN labels ON from_iri = iri WHERE lang = 'en'",
    "label_to_resource": f"WITH {NAMES} SELECT label, min(iri) AS iri FROM known WHERE label IN (SELECT label FROM labels) GROUP BY label",
    "class_cascade": f"""WITH {NAMES}, keys AS (SELECT DISTINCT label, k AS key FROM labels, LATERAL (SELECT unnest([label, lower(label)]) AS k)),
      c AS (SELECT keys.label, list_sort(list_distinct(list(class) FILTER (kind = 'range'))) AS r, list_sort(list_distinct(list(class) FILTER (kind = 'type'))) AS t FROM keys LEFT JOIN known ON known.label = keys.key LEFT JOIN types USING (iri) GROUP BY keys.label)
      SELECT label, CASE WHEN len(r) > 0 THEN array_to_string(r, '|') WHEN len(t) > 0 THEN array_to_string(t, '|') ELSE '{NAMESPACES["owl"]}Thing' END AS classes FROM c""",
    "predicates_between_labels": "SELECT n_name AS subject_label, r_name AS object_label, '" + ONT + "region' AS p FROM nation JOIN region ON n_regionkey = r_regionkey",
    "iri_expand": f"SELECT * FROM (VALUES ('foaf:name', '{NAMESPACES['foaf']}name'), ('rdfs:label', '{RDFS}label'), ('dbpedia-owl:abstract', '{ONT}abstract'), ('http://x/y:z', 'http://x/y:z'), ('nope:x', NULL)) AS t(iri, expanded)",
    "unworded_triples": f"WITH {TRIPLES}, {WORDED}, u AS (SELECT DISTINCT subject, p FROM worded WHERE wording IS NULL) SELECT t.p, count(*) AS n, count(DISTINCT t.o_value) AS objects FROM triples t JOIN u USING (subject, p) WHERE NOT starts_with(t.p, '{RAW_PROPERTY}') GROUP BY t.p",
    "wording_int": f"SELECT p_partkey, {INT('p_size * 123456 - 2000000')} AS worded FROM part",
    "wording_float": f"SELECT c_custkey, {FLOAT('c_acctbal')} AS worded FROM customer",
    "wording_units": f"SELECT p_partkey, {FLOAT('p_size')} || ' in' AS inch, {FLOAT('p_size * 1000')} || ' km' AS km, {FLOAT('p_size * 1000')} AS km2 FROM part",
    "wording_date": f"SELECT o_orderkey, {DATE('o_orderdate')} AS worded, {DATE('o_orderdate')} || ' B.C.' AS before FROM orders",
    "wording_dispatch": f"WITH {TRIPLES}, {WORDED} SELECT p, count(*) AS n, count(wording) AS worded, min(wording) AS least, max(wording) AS most FROM worded GROUP BY p",
    "class_phrases": "SELECT r_name, 'The ' || lower(r_name[1]) || substr(r_name, 2) || '|the ' || lower(r_name[1]) || substr(r_name, 2) AS phrases FROM region",
    "numeric_and_title_tokens": f"SELECT w, count(*) AS n, regexp_matches(w, '^\\p{{Nd}}') AS numeric FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' AND ({TITLE} OR regexp_matches(w, '^\\p{{Nd}}')) GROUP BY w",
    "title_normalisation": "SELECT p_partkey, upper(p_name[1]) || substr(p_name, 2) AS title, p_brand || ' ' || p_type AS key, regexp_replace(p_brand, '\\W+', '.', 'g') AS file FROM part",
    "article_urls": "SELECT p_partkey, 'http://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS url, 'http://en.wikipedia.org/wiki?curid=' || p_partkey AS curid FROM part",
    "sentence_guard": f"SELECT lang, count(*) FILTER ({_ADMIT}) AS taken, count(*) FILTER (NOT ({_ADMIT})) AS refused FROM (SELECT lang, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY lang",
    "adjust_dates": f"WITH {MARKUP} SELECT page_id, {_DATES('text')} AS text FROM markup",
    "html_strip": f"SELECT page_id, md5(regexp_replace({_COMMENTS}, '<[^>]+>', '', 'g')) AS digest FROM pages",
    "entities_unescape_subset": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&nbsp;', chr(32)), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS digest FROM pages",
    "comments_removed": f"SELECT page_id, length({_COMMENTS}) AS length FROM pages",
    "section_titles": f"WITH {MARKUP} SELECT page_id, replace(text, '== Size ==', '') AS text FROM markup",
    "wiki_bold": f"WITH {MARKUP} SELECT page_id, replace(replace(text, repeat(chr(39), 3), ''), repeat(chr(39), 2), '\"') AS text FROM markup",
    "external_links": f"WITH {MARKUP} SELECT page_id, split_part(text, chr(10), 1) || chr(10) || ' links ' || n_name || ' ' || repeat(chr(39), 3) || title || repeat(chr(39), 3) || ' the site ' || repeat(chr(39), 2) || 'italic' || repeat(chr(39), 2) || chr(10) || split_part(text, chr(10), 3) || chr(10) || split_part(text, chr(10), 4) || chr(10) || '   ' AS text FROM markup",
    "wiki_links": f"WITH {MARKUP} SELECT page_id, split_part(text, chr(10), 1) || chr(10) || ' links ' || n_name || ' ' || repeat(chr(39), 3) || title || repeat(chr(39), 3) || ' [http://a.org/x the site] ' || repeat(chr(39), 2) || 'italic' || repeat(chr(39), 2) || chr(10) || split_part(text, chr(10), 3) || chr(10) || split_part(text, chr(10), 4) || chr(10) || '   ' AS text FROM markup",
    "templates_expanded": f"WITH {MARKUP} SELECT page_id, {FLOAT('p_size * 1.609344')} || ' km and ' || {FLOAT('p_size * 2.589988110336')} || ' km2, ' || title || ' as of 1999 1998-1999 ' || substr(text, strpos(text, chr(10))) AS text FROM markup",
    "page_categories": f"WITH {MARKUP} SELECT page_id, 'Category:' || p_brand || '|Category:' || p_type AS piped, 'Category:' || p_brand || '|Category:' || p_type || '|Category:Bare' AS \"all\" FROM markup",
    "category_index": f"WITH {MARKUP} SELECT 'Category:' || c AS category, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM (SELECT page_id, unnest([p_brand, p_type]) AS c FROM markup) GROUP BY c",
    "category_sizes": f"WITH {MARKUP} SELECT 'Category:' || c AS category, count(*) AS n FROM (SELECT page_id, unnest([p_brand, p_type]) AS c FROM markup) GROUP BY c",
    "lang_equiv": f"WITH {MARKUP} SELECT page_id, title AS de, CAST(NULL AS VARCHAR) AS fr FROM markup",
    "title_index": "SELECT p_name AS title, min(p_partkey) AS page_id FROM part GROUP BY p_name",
    "page_lookup": f"WITH {MARKUP} SELECT title, page_id, length(text) AS length FROM markup WHERE page_id = (SELECT min(p_partkey) FROM part WHERE p_name = 'red widget')",
    "article_filter": "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 7 = 0 THEN 'w:' ELSE '' END || p_name AS title FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0",
    "dump_stats": f"WITH {MARKUP} SELECT lang, count(DISTINCT page_id) AS pages, count(DISTINCT c) AS categories FROM (SELECT lang, page_id, unnest(['B' || p_brand, 'T' || p_type]) AS c FROM markup) GROUP BY lang",
    "lang_dist": "SELECT lang, count(*) AS pages FROM documents GROUP BY lang",
    "length_stats": f"SELECT lang, median(bytes) AS median, round(avg(bytes), 6) AS mean, round(stddev_pop(bytes), 6) AS std FROM {_PAGES} GROUP BY lang",
    "length_overall": f"WITH e AS (SELECT median(bytes) AS m, avg(bytes) AS a, stddev_pop(bytes) AS s FROM {_PAGES} GROUP BY lang) SELECT round(median(bytes), 6) AS median, round(avg(bytes), 6) AS mean, round(stddev_pop(bytes), 6) AS std, (SELECT round(avg(m), 6) FROM e) AS mean_median, (SELECT round(avg(a), 6) FROM e) AS mean_mean, (SELECT round(avg(s), 6) FROM e) AS mean_std FROM {_PAGES}",
    "length_thresholds": f"SELECT lang, t AS threshold, count(*) FILTER (bytes < t) AS under, round(count(*) FILTER (bytes < t) / count(*), 9) AS proportion FROM {_PAGES}, (SELECT unnest([5000, 2000, 1000, 500, 200, 100, 50, 20, 10]) AS t) GROUP BY ALL",
    "length_histogram": f"WITH e AS (SELECT lang, (avg(bytes) + 3 * stddev_pop(bytes)) / 1000 AS step FROM {_PAGES} GROUP BY lang) SELECT lang, least(CAST(floor(bytes / step) AS BIGINT), 999) AS bin, count(*) AS n FROM {_PAGES} JOIN e USING (lang) WHERE bytes >= step AND bytes <= step * 1000 GROUP BY ALL",
    "docs_under_threshold": f"SELECT lang || '_' || page_id AS docid, bytes FROM {_PAGES} WHERE bytes < 1000",
    "naive_subject_stats": f"""WITH {FACTS}, j AS (SELECT subject, p, wording, contains(lower(text), lower(wording)) AND regexp_matches(text, {_context(1)}) AS hit FROM facts JOIN documents ON subject = doc_id WHERE p NOT IN ({IGNORED}))
      SELECT subject, count(DISTINCT p) FILTER (wording IS NOT NULL) AS total, count(DISTINCT p) FILTER (hit) AS present, total - present AS absent, round(present / total, 9) AS ratio FROM j GROUP BY subject""",
    "naive_context_counts": f"WITH {CONTEXTS} SELECT * FROM counts",
    "naive_context_top5": f"WITH {CONTEXTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY n DESC, string) AS rank FROM counts) WHERE rank <= 5",
    "naive_couplings": f"WITH {CONTEXTS} SELECT p, count(*) AS couplings FROM (SELECT DISTINCT p, preceding, following FROM rows) GROUP BY p",
    "predicate_wordings": f"WITH {FACTS} SELECT p, string_agg(DISTINCT wording, '|' ORDER BY wording) AS wordings FROM facts WHERE wording IS NOT NULL GROUP BY p",
    "predicate_occurrences": f"WITH {FACTS}, {LINES}, hits AS (SELECT DISTINCT subject, p, wording FROM facts JOIN lines ON article = subject AND contains(s, wording)) SELECT f.subject, f.p, count(DISTINCT h.wording) AS occurrences FROM facts f LEFT JOIN hits h ON h.subject = f.subject AND h.p = f.p WHERE f.wording IS NOT NULL AND f.p NOT IN ({IGNORED}) GROUP BY ALL",
    "multiset_count": f"WITH {BAGS} SELECT * FROM a",
    "multiset_add": f"WITH {BAGS} SELECT elem, x + y AS n FROM both_",
    "multiset_sub": f"WITH {BAGS} SELECT elem, x - y AS n FROM both_ WHERE x > y",
    "multiset_or": f"WITH {BAGS} SELECT elem, greatest(x, y) AS n FROM both_",
    "multiset_and": f"WITH {BAGS} SELECT elem, least(x, y) AS n FROM both_ WHERE least(x, y) > 0",
    "multiset_elements": f"WITH {BAGS} SELECT elem, least(x, y) AS n FROM both_ WHERE least(x, y) > 0",
    "multiset_most_common": f"WITH {BAGS} SELECT * FROM a ORDER BY n DESC, elem LIMIT 20",
    "multiset_lookup": f"WITH {BAGS} SELECT b.elem, coalesce(a.n, 0) AS n FROM b LEFT JOIN a USING (elem)",
    "sample_exact_k": f"SELECT doc_id AS page_id, lang FROM documents ORDER BY {_DRAW('doc_id', 7)}, doc_id LIMIT 200",
    "sample_per_lang": f"SELECT page_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW('page_id', 7)}, page_id) AS r FROM {_PAGES} WHERE bytes >= 500) WHERE r <= 25",
    "weighted_choice": f"WITH {_CHOICE} SELECT * FROM chosen",
    "language_sample": f"WITH {_CHOICE} SELECT item AS lang, count(*) AS n FROM chosen GROUP BY item",
    "partition_probabilistic": f"SELECT doc_id AS page_id, CASE WHEN u < 3 / 6.0::DOUBLE THEN 0 WHEN u < 4 / 6.0::DOUBLE THEN 1 ELSE 2 END AS part FROM (SELECT doc_id, {_U('doc_id', 5)} AS u FROM documents)",
    "partition_exact": f"""WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, n * 3 // 6 AS a, n * 1 // 6 AS b, n * 2 // 6 AS c FROM n),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY {_U("doc_id", 5)}, doc_id) - 1 AS r FROM documents)
      SELECT doc_id AS page_id, CASE WHEN r < n - a - b - c THEN r % 3 WHEN r < n - b - c THEN 0 WHEN r < n - c THEN 1 ELSE 2 END AS part FROM r, s""",
    "dep_edges": f"WITH {TOKENS} SELECT lab AS label, i // 2 AS tail, count(*) AS n FROM tok GROUP BY ALL",
    "root_paths": f"WITH {TOKENS} SELECT sentence_id, count(*) + 1 AS nodes, CAST(floor(log2(max(i))) AS BIGINT) + 2 AS longest FROM tok GROUP BY sentence_id",
    "reached_from_root": f"WITH {TOKENS} SELECT sentence_id, count(*) + 1 AS nodes, count(*) + 1 AS reached FROM tok GROUP BY sentence_id",
    "associated_wording": f"WITH {TOKENS} SELECT wording, nested, count(*) AS n FROM phr GROUP BY ALL",
    "harvest_patterns": f"WITH {HARVEST} SELECT hash, predicate, any_value(n_edges) AS edges, any_value(ents) AS entities, any_value(num) AS object_is_numeric FROM (SELECT h.*, coalesce(e.ents, 0) AS ents, false AS num FROM harvested h LEFT JOIN (SELECT sentence_id, predicate, count(*) AS ents FROM named WHERE kind = 'E' GROUP BY ALL) e USING (sentence_id, predicate)) GROUP BY hash, predicate",
    "pattern_sources": f"WITH {HARVEST} SELECT DISTINCT hash AS pattern, article, md5(sentence) AS sentence, subject_wording, object_wording FROM full_",
    "gallery_pages": f"WITH {HARVEST}, g AS (SELECT predicate, count(DISTINCT hash) AS patterns FROM harvested GROUP BY predicate) SELECT *, row_number() OVER (ORDER BY predicate) - 1 AS ordinal, (row_number() OVER (ORDER BY predicate) - 1) // 2 AS page FROM g",
    "gallery_totals": f"WITH {HARVEST} SELECT count(DISTINCT subject_wording || ',' || predicate || ',' || object_wording) AS triples, count(DISTINCT hash) AS used_patterns, count(*) AS matches FROM harvested",
    "gallery_sources_top5": f"WITH {HARVEST}, d AS (SELECT DISTINCT subject_wording, predicate, object_wording, sentence FROM full_), r AS (SELECT *, row_number() OVER (PARTITION BY subject_wording, predicate, object_wording ORDER BY sentence) AS r FROM d) SELECT subject_wording, predicate, object_wording, md5(string_agg(sentence, chr(10) ORDER BY sentence) FILTER (r <= 5)) AS sentences, greatest(count(*) - 5, 0) AS more FROM r GROUP BY ALL",
    "patterns_with_sources": f"WITH {HARVEST} SELECT hash, count(DISTINCT subject_wording || '|' || object_wording) AS pairs FROM harvested GROUP BY hash",
    "upsert_last_writer": """WITH r AS (SELECT *, event_type = 'purchase' AS new, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts DESC, event_id DESC) AS r FROM events)
      SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY new DESC) AS k FROM r WHERE r = 1) WHERE k = 1""",
    "doc_format_export": "SELECT md5('<doc id=\"' || doc_id || '\" url=\"http://en.wikipedia.org/wiki?curid=' || doc_id || '\" title=\"' || source || '\">' || chr(10) || source || chr(10) || chr(10) || text || chr(10) || '</doc>') AS digest FROM documents",
    "output_files": "SELECT page_id, f AS file_no, chr(65 + CAST(f // 100 // 26 AS INT) % 26) || chr(65 + CAST(f // 100 AS INT) % 26) AS folder FROM (SELECT page_id, CAST((sum(bytes) OVER (ORDER BY page_id) - bytes) // 100000 AS BIGINT) AS f FROM " + _PAGES + ")",
}
