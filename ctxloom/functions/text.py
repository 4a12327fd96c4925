"""Text functions as columns: tokens, language, markdown, tags, samples, similarity, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}]"
ASTRAL = "[\\x{10000}-\\x{10ffff}]"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def token_estimate(text: Column) -> Column:
    """1.5 for an East Asian letter, 2 for a character beyond the basic plane, a quarter for others; rounded up."""
    cjk, astral = matches(text, CJK), matches(text, ASTRAL)
    return F.ceil(cjk * 1.5 + astral * 2.0 + (F.length(text) - cjk - astral) * 0.25)


def markdown_tokens(text: Column) -> Column:
    cjk = matches(text, CJK)
    return F.floor(cjk * 0.7 + (matches(text, r"\S") - cjk) * 0.3)


def slug(text: Column) -> Column:
    """Lower case, words joined by single hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 _-]", ""), r"[ _-]+", "-"), F.lit("-"))


def html_to_text(html: Column) -> Column:
    h = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        h = F.replace(h, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(h, r"[ \t\r\n]+", " "))


def frontmatter(text: Column) -> Column:
    """The key: value lines of a leading --- block."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(": "))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"))))


#: Common words of each Latin-script language.
STOPWORDS = {"en": ("the", "of", "and", "to", "in", "is"), "de": ("der", "die", "und", "das", "von", "den"), "es": ("el", "los", "que", "del", "las", "por"), "fr": ("le", "les", "des", "est", "une", "dans")}


def language(df: DataFrame, text: str, out: str = "lang") -> DataFrame:
    """df with the language of a text column: by script if a fifth of the letters are of one, else by the commonest
    stop words; und if none occurs. """
    score, kept, c = "_score", df.columns, F.col(text)
    while score in kept:
        score += "_"
    every = tuple(w for v in STOPWORDS.values() for w in v)
    # a text is split once; what is counted by language are its few stop words
    df = df.withColumn(score, F.filter(F.split(F.lower(c), r"[^\p{L}]+"), _one_of(every)))
    df = df.withColumn(score, _stopword_counts(F.col(score)))
    best = F.greatest(*(F.col(f"{score}.{k}") for k in STOPWORDS))
    n = F.greatest(F.length(c), F.lit(1))
    script = F.when(matches(c, "[\\x{3040}-\\x{30ff}]") * 5 > n, "ja").when(matches(c, "[\\x{ac00}-\\x{d7af}]") * 5 > n, "ko").when(matches(c, CJK) * 5 > n, "zh").when(matches(c, "[\\x{0400}-\\x{04ff}]") * 5 > n, "ru").when(matches(c, "[\\x{0600}-\\x{06ff}]") * 5 > n, "ar")
    # texts without a letter of these scripts need no counting
    script = F.when(c.rlike("[\\x{0400}-\\x{06ff}\\x{3040}-\\x{d7af}]"), script)
    lang = F.when(script.isNotNull(), script).when(best == 0, "und")
    for k in STOPWORDS:
        lang = lang.when(F.col(f"{score}.{k}") == best, k)
    return df.select(*(F.col(x) for x in kept if x != out), lang.alias(out))


def _stopword_counts(words: Column) -> Column:
    """A struct of how many of the words are stop words of each language."""
    return F.struct(*(F.size(F.filter(words, _one_of(v))).alias(k) for k, v in STOPWORDS.items()))


def _one_of(words: tuple):
    return lambda x: x.isin(*words)


def tags_normalised(tags: Column) -> Column:
    """Lower-case, trimmed k=v tags, each once, in order."""
    t = F.transform(tags, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(t, lambda x: x.rlike(r"^[^=\s]+=[^=]+$")))


def tags_merged(old: Column, new: Column) -> Column:
    """New tags replace old ones of the same key."""
    key = lambda x: F.split_part(x, F.lit("="), F.lit(1))
    keys = F.transform(new, key)
    return F.concat(F.filter(old, lambda x: ~F.array_contains(keys, key(x))), new)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def head_tail(text: Column, head: int, tail: int, gap: str = " ... ") -> Column:
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(gap), F.right(text, F.lit(tail))))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("...")))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "\u2018\u2019\u201c\u201d", "''\"\"")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    a, b = straight_quotes(a), straight_quotes(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def answer_words(text: Column) -> Column:
    """Lower-case words without punctuation and articles."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} \t\r\n]", "")
    return F.filter(F.split(t, r"[ \t\r\n]+"), lambda x: ~x.isin("", "a", "an", "the"))


def links_stripped(text: Column) -> Column:
    """[label](target) -> label."""
    return F.regexp_replace(text, r"\[([^\]\[]*)\]\([^)(]*\)", "$1")


def references(text: Column, scheme: str = "ctx") -> Column:
    """URIs outside code spans and fences."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`]*`", " ")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"({scheme}://[A-Za-z0-9_./-]*[A-Za-z0-9_/-])"), F.lit(1)))


def content_kind(path: Column) -> Column:
    """Kind of content by suffix."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"), "image").when(ext.isin("mp4", "mov", "avi", "mkv", "webm"), "video").when(ext.isin("mp3", "wav", "ogg", "flac", "m4a"), "audio").when(ext.isin("md", "txt", "html", "json", "csv", "xml", "py", "yaml", "yml"), "text").otherwise("other")
