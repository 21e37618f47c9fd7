"""Quality rules by counts and distribution divergence (operator 9), in DataFrame functions alone.

Each document gets exact counts, a histogram of character classes and a histogram of its language's common words.
The histograms of all documents of a language that pass the count rules, added up over the whole table, are that language's
first reference; those of the documents near it are the final one. A document is rejected when the Jensen-Shannon distance
of its character classes exceeds a threshold. Distances of short texts are noise: below one length the common words must
be far from the reference as well, and below a second nothing is rejected.

Within a text, repeated 3-word windows are found without leaving the row: window hashes carry their position in the
low bits, one primitive sort brings equal windows together, and neighbours that agree are compared word by word. In a text where neighbours
agree in their hash alone, equal windows need not be neighbours: such a text's windows are sorted as text instead.

With ``own_references`` each value of the language column has a reference of its own, however rare its script is elsewhere, and
one of fewer than ``MIN_REFERENCE`` characters rejects nothing. Without it unlisted languages share one reference.

Defined results: a null or empty text has no words and fails the count rules. Documents without a language share one
reference. Repeated rows are judged alike, each on its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, spread, written

SYMBOLS = "#*$%&|<>"
#: Function words by language; the last entry serves texts of any other language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un"],
    "": ["the", "de", "la", "der", "die", "und", "of", "and", "el", "le"],
}
#: The hash of the window of words that begins with word x at position i of _w.
WINDOW_HASH = "xxhash64(x, get(_w, i + 1), get(_w, i + 2))"
CLASSES = ("separator", "upper", "digit", "symbol", "stop", "exclamation", "beyond_ascii", "rest")
MIN_WORDS = 50
#: A row nearer than both to the sums over all rows counts for the reference.
FIRST_CLASS_DISTANCE, FIRST_WORD_DISTANCE = 0.2, 0.3
#: A text this far from its language's character classes is rejected if it is long enough for that measure alone,
#: or if it is shorter and its common words are missing as well; a shorter one yet is left alone.
MAX_CLASS_DISTANCE, MIN_CHARS_ALONE = 0.165, 1000
MAX_WORD_DISTANCE, MIN_CHARS = 0.26, 250
#: Characters of a language's own reference below which nothing is held against it.
MIN_REFERENCE = 20_000
#: References are broadcast up to this many languages (some 200 bytes each), counted first; more are joined as Spark plans it.
BROADCAST_LANGUAGES = 100_000


def _without(c: Column, chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", carry: bool = False, own_references: bool = False) -> DataFrame:
    """One row per document: the counts, both histograms and its reference's name; with ``carry`` also ``_row``, all of its columns."""
    language = F.lit("") if lang is None else F.when(F.col(lang).isin(*[x for x in COMMON if x]), F.col(lang)).otherwise("")
    reference = F.coalesce(F.col(lang).cast("string"), F.lit("")) if own_references and lang is not None else language
    own = [F.struct("*").alias("_row")] if carry else []
    df = spread(docs if carry else docs.select(key, text, *([lang] if lang else [])))
    df = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"), language.alias("_lang"), reference.alias("_reference"), *own)
    df = df.select("*", F.btrim("_t", F.lit(SEPARATORS)).alias("_trim"))
    df = df.select("*", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", r"[ \t-\r]+")).alias("_w"), _without(F.col("_t"), SEPARATORS).alias("_dense"))
    df = df.select("*", F.size("_w").cast("bigint").alias("n_words"), F.length(F.bin(F.size("_w"))).alias("_bits"))
    # Windows as sorted longs: the hash above, the position in the low bits. The last two positions start no window; their hashes take fewer words.
    df = df.select("*", F.expr(f"sort_array(transform(_w, (x, i) -> ({WINDOW_HASH} & ~(shiftleft(1L, _bits) - 1L)) | i))").alias("_k"))
    agree = lambda k: f"shiftright(k, _bits) = shiftright({k}, _bits) AND " + " AND ".join(f"get(_w, int(k & (shiftleft(1L, _bits) - 1L)) + {d}) = get(_w, int({k} & (shiftleft(1L, _bits) - 1L)) + {d})" for d in (0, 1, 2))
    fast = f"sort_array(transform(filter(_k, (k, j) -> coalesce({agree('get(_k, j + 1)')}, false) OR coalesce({agree('get(_k, j - 1)')}, false)), k -> k & (shiftleft(1L, _bits) - 1L)))"
    # Words hold no blanks, so a window's words joined by blanks are the window.
    texts = "sort_array(transform(filter(sequence(0, size(_w) - 3), i -> i >= 0 AND i < size(_w) - 2), i -> struct(concat(_w[i], ' ', _w[i + 1], ' ', _w[i + 2]) AS s, cast(i AS bigint) AS i)))"
    slow = f"sort_array(transform(array({texts}), a -> transform(filter(a, (e, j) -> coalesce(get(a, j + 1).s = e.s, false) OR coalesce(get(a, j - 1).s = e.s, false)), e -> e.i))[0])"
    alike = "shiftright(k, _bits) = shiftright(get(_k, j + 1), _bits)"
    clash = f"size(filter(_k, (k, j) -> {alike} AND NOT coalesce({agree('get(_k, j + 1)')}, false))) > 0"
    df = df.select("*", F.expr(f"CASE WHEN size(_w) >= 3 AND {clash} THEN {slow} ELSE {fast} END").alias("_r"))
    lines = F.expr(r"filter(split(_t, '\n'), x -> x RLIKE '[^ \\t-\\r]')")
    df = df.select("*", lines.alias("_l"), F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" ")).alias("_spaced"))
    dense, plain = F.octet_length("_dense"), F.octet_length(_without(F.col("_dense"), SYMBOLS))
    chars, word_chars = F.length("_t"), F.length("_dense")
    class_counts = {
        "separator": chars - word_chars,
        "upper": F.octet_length("_dense") - F.octet_length(F.regexp_replace("_dense", "[A-Z]+", "")),
        "digit": F.octet_length("_dense") - F.octet_length(F.regexp_replace("_dense", "[0-9]+", "")),
        "symbol": dense - plain,
        "stop": dense - F.octet_length(_without(F.col("_dense"), ".,")),
        "exclamation": dense - F.octet_length(_without(F.col("_dense"), "!")),
        "beyond_ascii": dense - word_chars,
    }
    known = [class_counts[c].cast("bigint") for c in CLASSES[:-1]]
    total = chars.cast("bigint")
    hit = lambda w: ((F.octet_length("_spaced") - F.octet_length(F.replace("_spaced", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("bigint")
    by_language = None
    for code, words in COMMON.items():
        histogram = F.array(*[hit(w) for w in words])
        if code:
            by_language = (F if by_language is None else by_language).when(F.col("_lang") == code, histogram)
        else:
            by_language = by_language.otherwise(histogram)
    df = df.select(
        key, "_reference", *(["_row"] if carry else []), "n_words", word_chars.cast("bigint").alias("word_chars"), (dense - plain).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.expr("aggregate(transform(_r, (x, j) -> least(3L, coalesce(get(_r, j + 1) - x, 3L))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.array(*known, F.greatest(total - sum(known[1:], known[0]), F.lit(0))).alias("_classes"), by_language.alias("_common"),
    )
    df = df.withColumn("_common", F.expr("concat(_common, array(greatest(n_words - aggregate(_common, 0L, (a, x) -> a + x), 0L)))"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; 0 where either is empty."""
    share = lambda a: f"transform({a}, x -> x / nullif(aggregate({a}, 0L, (s, x) -> s + x), 0L))"
    term = lambda x: f"if({x} > 0, {x} * log2(2 * {x} / (a + b)), 0D)"
    return F.expr(f"coalesce(sqrt(greatest(aggregate(zip_with({share(p)}, {share(q)}, (a, b) -> ({term('a')} + {term('b')}) / 2), 0D, (s, x) -> s + x), 0D)), 0D)")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", own_references: bool = False) -> DataFrame:
    """Counts with ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    df = _judged(written(counts(docs, key, text, lang, own_references=own_references)), own_references)
    return df.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def sound(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang", own_references: bool = False) -> DataFrame:
    """The kept documents with all their columns. Rows are written once with their counts, so that no text is exchanged."""
    return _judged(written(counts(docs, key, text, lang, carry=True, own_references=own_references)), own_references).where("kept").select("_row.*")


def _judged(found: DataFrame, own_references: bool = False) -> DataFrame:
    sizes = {"_classes": len(CLASSES), "_common": len(COMMON[""]) + 1}
    # Listed languages and one row for the rest are len(COMMON) rows; languages as the table has them are counted.
    small = not own_references or found.select("_reference").distinct().count() <= BROADCAST_LANGUAGES

    def measured(sound: Column, df: DataFrame) -> DataFrame:
        """Distances to the sums over the sound rows of each language."""
        sums = [F.array(*[F.sum(F.when(sound, F.get(c, F.lit(i))).otherwise(0)) for i in range(n)]).alias(f"_ref{c}") for c, n in sizes.items()]
        references = df.groupBy("_reference").agg(*sums)
        joined = found.join(F.broadcast(references) if small else references, "_reference")
        return joined.select("*", _distance("_classes", "_ref_classes").alias("class_distance"), _distance("_common", "_ref_common").alias("word_distance"))

    first = measured(~F.col("base_failed"), found)
    # Once more without the rows far from the first reference, so that junk doesn't shape what it is held against.
    near = ~F.col("base_failed") & (F.col("class_distance") <= FIRST_CLASS_DISTANCE) & (F.col("word_distance") <= FIRST_WORD_DISTANCE)
    df = measured(near, first).withColumn("_n", F.expr("aggregate(_classes, 0L, (a, x) -> a + x)"))
    far = F.col("class_distance") > MAX_CLASS_DISTANCE
    odd = far & ((F.col("_n") >= MIN_CHARS_ALONE) | ((F.col("_n") >= MIN_CHARS) & (F.col("word_distance") > MAX_WORD_DISTANCE)))
    if own_references:
        odd &= F.expr(f"aggregate(_ref_classes, 0L, (a, x) -> a + x) >= {MIN_REFERENCE}")
    return df.withColumn("kept", ~F.col("base_failed") & ~odd)
