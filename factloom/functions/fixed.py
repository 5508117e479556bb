"""Fixed values that results depend on: IRIs, tags, markup names and conversion factors."""

# Predicates that carry no fact for extraction.
IGNORED_PREDICATES = [
    "http://www.w3.org/2000/01/rdf-schema#comment",
    "http://www.w3.org/2000/01/rdf-schema#label",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#type",
    "http://www.w3.org/2002/07/owl#sameAs",
    "http://dbpedia.org/ontology/abstract",
    "http://dbpedia.org/ontology/thumbnail",
    "http://dbpedia.org/ontology/wikiPageExternalLink",
    "http://xmlns.com/foaf/0.1/name",
    "http://xmlns.com/foaf/0.1/depiction",
    "http://purl.org/dc/elements/1.1/subject",
    "http://purl.org/dc/terms/subject",
    "http://xmlns.com/foaf/0.1/isPrimaryTopicOf",
    "http://xmlns.com/foaf/0.1/homepage",
]

# Namespace prefixes.
NAMESPACES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dbpedia-owl": "http://dbpedia.org/ontology/",
    "dbpdatatype": "http://dbpedia.org/datatype/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "dbpedia": "http://dbpedia.org/resource/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
}
RAW_PROPERTY = "http://dbpedia.org/property"

# Placeholders in patterns, and the parser's root node.
ROOT_TAG, SUBJECT_TAG, OBJECT_TAG = "ROOT_P", "SUBJECT_P", "OBJECT_P"
ENTITY_PREFIX, NUMERIC_PREFIX = "ENTITY_P_", "NUMERIC_P_"
ROOT_NODE = "ROOT-0"
#: Relations that tie the words of a noun phrase together.
PHRASE_RELATIONS = ["nn", "num", "number", "amod"]

# Markup elements by what happens to them.
ACCEPTED_NAMESPACES = ["w"]
SELF_CLOSING = ["br", "hr", "nobr", "ref", "references"]
UNWRAPPED = [
    "a", "b", "big", "blockquote", "center", "cite", "div", "em", "font", "h1", "h2", "h3", "h4", "hiero", "i",
    "kbd", "nowiki", "p", "plaintext", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var",
]
DISCARDED = [
    "gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "form", "input", "select",
    "option", "textarea", "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap",
    "source",
]
PLACEHOLDERS = {"math": "formula", "code": "codice"}

# The word for a category by language.
CATEGORY_WORDS = {
    "en": "Category", "fr": "Catégorie", "de": "Kategorie", "ja": "Category", "it": "Categoria",
    "ru": "Категория", "pl": "Kategoria", "nl": "Categorie", "sv": "Kategori", "zh": "Category",
}
#: Interlanguage prefixes follow a rule: two or three small letters, perhaps with a part after a hyphen.
LANGUAGE_PREFIX = "[a-z]{2,3}(?:-[a-z]+)*"

# Names of months, and units that are converted to kilometres or square kilometres.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
KILOMETRES = {"mi": 1.609344, "km": 1.0}
SQUARE_KILOMETRES = {"sqmi": 2.589988110336, "km2": 1.0}
#: Components of pronunciation templates that are not part of the pronunciation.
PRONUNCIATION_EXTRAS = ["icon", "lang", "english", "pron", "pronunciation", "local", "ipa", "us", "uk", "-"]

# What a word around a wording is made of, what it follows and what may end it. A-z also admits the six
# characters between Z and a.
CONTEXT_WORD, CONTEXT_GAP, CONTEXT_STOP = r"[A-z0-9_\-()\"%]", r"['\s]", "[;,:]"

# Rules of the markup cleaner as (pattern, replacement), in the order in which they apply. Results depend
# on each of them and on their order.
SECTION_TITLE = r"(==+)\s*(.*?)\s*\1"
EXTERNAL_LINK_RULES = [
    (r"\[\w+[^\n\]]*? ([^\n]*?)\]", "$1"),
    (r"\[\w+[&\]]*\]", ""),
]
QUOTE_RULES = [
    (r"'''''([^']*?)'''''", "$1"),
    (r"'''(.*?)'''", "$1"),
    (r"''\"(.*?)\"''", '"$1"'),
    (r"''([^']*)''", '"$1"'),
    (r'""(.*?)""', "$1"),
    ("'''", ""),
    ("''", '"'),
]
TIDY_RULES = [
    ("<<", "«"),
    (">>", "»"),
    (r"(?m)^ .*?$", ""),
    (r"\t", " "),
    (" {2,}", " "),
    (r"\.{4,}", "..."),
    (r"\n[^\p{L}\p{N}_]+?\n", "\n"),
    (",,", ","),
    (r",\.", "."),
]
# An element with its content, one without, and either tag of one, by name.
WHOLE_ELEMENT = r"(?is)<\s*{0}\b[^>]*>.*?<\s*/\s*{0}>"
CLOSED_ELEMENT = r"(?is)<\s*(?:{0})\b[^/]*/\s*>"
EITHER_TAG = r"(?i)<\s*/?\s*(?:{0})\b[^>]*>"
PLACEHOLDER_ELEMENT = r"(?is)<\s*{0}(?:\s*| [^>]+?)>.*?<\s*/\s*{0}\s*>"
# Marks by which lines of cleaned text are told apart: page titles, list items, table rows and their ends, bracketed lines.
TITLE_MARK, ITEM_MARKS, TABLE_MARKS, TABLE_END, BRACKETS, RULER = "++", "*#:;", "{|", "}", "()", ".-"
