"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the canonical tokenizer and of the query tokenizer.
TOKEN = "[a-zà-ɏ'-]+"
QUERY_TOKEN = "[a-z0-9]+"
#: Accented letters that the Latin filter removes, in either case.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿ"
#: Signs of broken encodings and their repairs.
BROKEN = {"\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2018": "'", "\u2019": "'", "\u200b": "", "\ufeff": ""}


def is_blank(c: Column) -> Column:
    """Null, empty or white space alone."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def even_lines(c: Column) -> Column:
    """Blanks and tabs collapse, three line feeds or more become two; none of them at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def tokens(c: Column, least: int = 1) -> Column:
    """Canonical tokens: lower case, letters with ' and -, none of these at the ends, `least` letters or more."""
    letter = TOKEN.removesuffix("+").replace("'-", "")
    found = F.regexp_extract_all(F.lower(c), F.lit(f"{letter}(?:{TOKEN.removesuffix('+')}*{letter})?"), F.lit(0))
    return F.filter(found, lambda x: F.length(x) >= least) if least > 1 else found


def query_tokens(c: Column, stop: list[str], most: int = 6) -> Column:
    """Distinct query terms without stop words, the first `most`."""
    found = F.regexp_extract_all(F.lower(c), F.lit(QUERY_TOKEN), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(stop))), 1, most)


def words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Split behind . ! ? and white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def ngrams(array: Column, n: int) -> Column:
    """All n-grams of an array of words, joined by spaces."""
    return F.when(F.size(array) >= n, F.transform(F.sequence(F.lit(1), F.size(array) - (n - 1)), lambda i: F.array_join(F.slice(array, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_shingles(c: Column, k: int) -> Column:
    """Distinct lower-cased k-character shingles."""
    none = F.array().cast("array<string>")
    # the letters are bound to a name first: a lambda computes whatever else it mentions anew for each element
    made = F.transform(F.array(F.split(F.lower(c), "")), lambda a: F.when(F.size(a) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(a) - (k - 1)), lambda i: F.array_join(F.slice(a, i, F.lit(k)), "")))).otherwise(none))
    return made[0]


def normal_md5(c: Column) -> Column:
    """MD5 of the text, lower-cased with collapsed white space."""
    return F.md5(collapse(F.lower(c)))


def hit_share(array: Column, lexicon: list[str]) -> Column:
    """Share of tokens that are in the lexicon; 0 without tokens."""
    return F.when(F.size(array) > 0, F.size(F.filter(array, lambda x: x.isin(lexicon))) / F.size(array)).otherwise(F.lit(0.0))


def density(array: Column, strong: list[str], medium: list[str], weak: list[str]) -> Column:
    """(3 strong + 2 medium + 1 weak) per token, five digits."""
    score = F.aggregate(array, F.lit(0), lambda a, x: a + F.when(x.isin(strong), 3).when(x.isin(medium), 2).when(x.isin(weak), 1).otherwise(0))
    return F.when(F.size(array) > 0, F.round(score / F.size(array), 5)).otherwise(F.lit(0.0))


def without_noisy_lines(c: Column, threshold: float = 0.30, least: int = 5) -> Column:
    """Blank lines stay; lines below `least` characters or with too few letters for their stripped length go."""
    def fine(line: Column) -> Column:
        letters, size = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.trim(line))
        return (F.trim(line) == "") | ((size >= least) & (1 - letters / size <= threshold))

    return F.array_join(F.filter(F.split(c, "\n"), fine), "\n")


def without_matching_lines(c: Column, pattern: str) -> Column:
    """Lines that match a pattern go."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def repaired(c: Column) -> Column:
    """Typographic quotes and dashes become plain ones; zero-width spaces and byte order marks go."""
    signs = sorted(BROKEN, key=lambda x: BROKEN[x] == "")  # translate() deletes signs without a partner
    return F.translate(c, "".join(signs), "".join(BROKEN[x] for x in signs))


def without_accents(c: Column) -> Column:
    """Accented letters of the fixed list are removed in either case, not replaced."""
    return F.translate(c, ACCENTED + ACCENTED.upper(), "")


def without_contacts(c: Column) -> Column:
    """URLs, mail addresses and phone numbers become blanks; white space is collapsed."""
    out = F.regexp_replace(c, r"https?://[^\s]+|www\.[^\s]+", " ")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " ")
    return collapse(F.regexp_replace(out, r"\+?[0-9][0-9 ()-]{7,}[0-9]", " "))


def visible_text(html: Column) -> Column:
    """Markup without script, style, comments and tags; the five common entities are read; white space is collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return collapse(out)


def slug(c: Column) -> Column:
    """Runs of other than a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over the larger size."""
    return F.when(F.greatest(F.size(a), F.size(b)) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc))).otherwise(0)


def relevance(query: str, c: Column) -> Column:
    """1 if equal, .85 for a prefix, else .7 of the share of query terms among the text's words plus .3 of a length factor; without any such term .5 if contained."""
    q, low = query.lower(), F.lower(c)
    terms, held = q.split(), words(c)
    met = sum((F.array_contains(held, t).cast("int") for t in terms), F.lit(0))
    factor = F.least(F.lit(1.0), 0.5 + 0.5 * F.lit(float(len(terms))) / F.greatest(F.size(held), F.lit(1)))
    ranked = F.when(met > 0, F.round(F.least(F.lit(1.0), met / F.lit(max(len(terms), 1)) * 0.7 + factor * 0.3), 4)).when(low.contains(q), 0.5).otherwise(0.0)
    return F.when(F.lit(not q) | c.isNull() | (c == ""), 0.0).when(low == q, 1.0).when(low.startswith(q), 0.85).when(F.size(held) == 0, 0.0).otherwise(ranked)


def duration_seconds(c: Column) -> Column:
    """'30s', '5m', '1h', '1d' as seconds; null for anything else."""
    n = F.regexp_extract(c, r"^([0-9]+)([smhd])$", 1)
    unit = F.regexp_extract(c, r"^([0-9]+)([smhd])$", 2)
    return F.when(n != "", n.cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400))


def timestamp_kind(c: Column) -> Column:
    """How a timestamp is written: canonical, space, zulu, other-offset, naive or unknown."""
    base = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    clock = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
    return (
        F.when(c.rlike(f"{base}T{clock}\\+00:00$"), "canonical").when(c.rlike(f"{base}T{clock}Z$"), "zulu").when(c.rlike(f"{base}T{clock}[+-][0-9]{{2}}:[0-9]{{2}}$"), "other-offset")
        .when(c.rlike(f"{base}T{clock}$"), "naive").when(c.rlike(f"{base} {clock}"), "space").otherwise("unknown")
    )


def source_confidence(n: Column) -> Column:
    """Confidence by number of distinct sources."""
    return F.when(n >= 4, 0.95).when(n == 3, 0.85).when(n == 2, 0.70).when(n == 1, 0.50).otherwise(0.10)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def regexp_words(c: Column) -> Column:
    """Letter runs as written."""
    return F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ɏ]+"), F.lit(0))
