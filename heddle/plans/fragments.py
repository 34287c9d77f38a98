"""DuckDB fragments that several queries share."""

TOK = "list_filter(list_transform(regexp_extract_all(lower({}), '[a-zà-ɏ''-]+'), lambda x: regexp_replace(x, '^[-'']+|[-'']+$', '', 'g')), lambda x: len(x) >= 1)"
TOKENS = TOK.format("text")
D = f"SELECT doc_id, source, lang, text, {TOKENS} AS t FROM documents"
EN = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "by", "or", "be", "at", "this", "from"]
FR = ["le", "la", "les", "de", "des", "un", "une", "et", "est", "dans", "que", "qui", "pour", "pas", "sur", "au", "du", "en", "par", "avec"]
DE = ["der", "die", "das", "und", "ist", "in", "den", "von", "zu", "mit", "nicht", "ein", "eine", "auf", "dem", "des", "im", "für", "sich", "auch"]


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"
