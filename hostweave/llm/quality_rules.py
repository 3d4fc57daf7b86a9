"""Quality rules by distribution divergence, in built-in functions only.

A document is described by two histograms: of its characters by class and of the
common words of a language. Both are compared, by Jensen-Shannon distance, with
references summed over all documents of each language; the nearest language
counts. The languages of ``COMMON_WORDS`` have fixed words. Every other language
of the table takes its most frequent words from the table, and its documents are
compared with its own reference as well.

A short text says little about its distribution. Words drawn from a reference are at
a distance from it whose square falls with their number, so the square of the largest
distance allowed is a constant for what texts differ in plus a share of 1 / words. Where
that would let any text of words pass, a text without one common word still fails. Below
its minimum length a comparison passes.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.llm.common import staged

# Frequent words of each language, as written inside a sentence.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on with as was by are be this or from".split(),
    "fr": "de la le et les des en un une du que qui dans pour est au par sur pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
OWN_WORDS = 20  # words of a language without fixed ones
SPACE = r"[\x20\x09-\x0D]"
#: Classes of characters in words; every other character is in a class of its own.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": "0-9", "symbol": "#*$%&|<>"}

MIN_WORDS = 50  # fewer fail the base rules
MAX_REPEATED = 50  # percent of the words in repeated three-word windows
#: Square of the largest distances of an ordinary document: the first number plus the second / words.
#: Set on labelled documents that are not held out, so that all good ones are well inside.
CLASS_LIMIT, WORD_LIMIT = (0.04, 3.6), (0.0225, 6.5)
#: Lengths from which the distances are asked for.
CLASS_MIN_CHARS, WORDS_MIN = 200, 50
#: Share of the distance of a text without common words that no text may exceed, if it is above the second number.
BARE_SHARE, BARE_MIN = 0.98, 0.285


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of shares; 1 without shares."""
    def side(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: (side(x, y) + side(y, x)) / 2)
    return F.when(_total(p) > 0, F.sqrt(F.greatest(_total(parts), F.lit(0.0)))).otherwise(1.0)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are told apart by hash first; only texts in which a hash repeats sort
    their windows, by hash and text, so the result is exact.
    """
    def window(i: Column) -> list[Column]:
        return [F.get(words, i + j) for j in range(3)]

    places = F.sequence(F.lit(0), F.size(words) - 3)

    def covered(found: Column) -> Column:
        """Words covered by windows starting at the ascending places ``found``."""
        return F.aggregate(
            found, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"])

    def sorted_count(_: Column) -> Column:
        rows = F.sort_array(F.transform(places, lambda i: F.struct(
            F.xxhash64(*window(i)).alias("hash"), F.concat_ws(" ", *window(i)).alias("text"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            def equal(x: Column, at: Column) -> Column:
                other = F.get(s, at)
                return F.coalesce((other["hash"] == x["hash"]) & (other["text"] == x["text"]), F.lit(False))

            twice = F.filter(s, lambda x, k: equal(x, k - 1) | equal(x, k + 1))
            return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

        return _let(rows, repeats)

    hashes = F.transform(places, lambda i: F.xxhash64(*window(i)))
    return F.when(F.size(words) < 3, 0).otherwise(_let(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(sorted_count(h))))


def _kept_length(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("bigint")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def with_own_words(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and own_words, the most frequent words of a language without fixed ones."""
    rows, none = docs.select("doc_id", "lang", "text"), F.lit(None).cast("array<string>").alias("own_words")
    other = F.coalesce(~F.col("lang").isin(list(COMMON_WORDS)), F.lit(False))
    if rows.where(other).select("lang").isEmpty():
        return rows.select("*", none)
    counts = rows.where(other).select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy(
        "lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    own = counts.withColumn("place", place).where(F.col("place") <= OWN_WORDS).groupBy("lang").agg(
        F.sort_array(F.collect_list("word")).alias("own_words"))
    return rows.where(~other).select("*", none).unionByName(rows.where(other).join(own, "lang", "left"))


def described(docs: DataFrame) -> DataFrame:
    """Per row of ``with_own_words``: base counts, characters by class and counts of common words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    words = docs.select(
        "doc_id", "lang", "own_words", _words(text).alias("words"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    counted = words.select(
        "doc_id", "lang", "n_dup_lines", F.size("words").cast("bigint").alias("n_words"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.array_join("words", "").alias("solid"),
        _let(F.filter("words", lambda w: F.array_contains("own_words", w)), lambda hits: F.transform(
            "own_words", lambda o: F.size(F.filter(hits, lambda w: w == o)).cast("bigint"))).alias("own_times"),
        F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(listed)), "  "), F.lit(" ")).alias("hits"))

    def times(word: str) -> Column:
        gone = F.octet_length("hits") - F.octet_length(F.replace(F.col("hits"), F.lit(f" {word} "), F.lit("")))
        return (gone / (len(word.encode()) + 2)).cast("bigint")

    classed = counted.select(
        "doc_id", "lang", "n_words", "n_dup_lines", "n_repeat_words",
        F.length("solid").cast("bigint").alias("word_chars"),
        *[_kept_length(F.col("solid"), c).alias(f"n_{name}") for name, c in CLASSES.items()],
        F.array(*[times(w) for w in listed]).alias("times"), "own_times")
    return classed.withColumnRenamed("n_symbol", "n_symbols").withColumn(
        "n_other", F.col("word_chars") - F.col("n_lower") - F.col("n_upper") - F.col("n_digit") - F.col("n_symbols"))


_CLASS_COUNTS = ["n_lower", "n_upper", "n_digit", "n_symbols", "n_other"]


def references(counts: DataFrame) -> list[tuple[str, list[float], list[float]]]:
    """(language, shares of character classes, shares of its common words and of the rest).

    Summed over all documents of the language; at most one row for each language
    of ``COMMON_WORDS`` reaches the driver.
    """
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    sums = counts.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(
        F.sum("n_words").alias("words"), *[F.sum(c).alias(c) for c in _CLASS_COUNTS],
        *[F.sum(F.get("times", F.lit(i))).alias(f"w{i}") for i in range(len(listed))]).collect()
    found = []
    for row in sorted(sums, key=lambda r: r["lang"]):
        chars = sum(row[c] for c in _CLASS_COUNTS)
        if chars:
            own = [row[f"w{listed.index(w)}"] / row["words"] for w in COMMON_WORDS[row["lang"]]]
            found.append((row["lang"], [row[c] / chars for c in _CLASS_COUNTS], [*own, 1 - sum(own)]))
    return found


def with_own_references(counts: DataFrame) -> DataFrame:
    """``counts`` with own_classes and own_shares, the references of languages without fixed words."""
    none = [F.lit(None).cast("array<double>").alias(c) for c in ("own_classes", "own_shares")]
    if counts.where("own_times is not null").isEmpty():
        return counts.select("*", *none)
    sums = counts.where("own_times is not null").groupBy("lang").agg(
        F.sum("n_words").alias("words"), F.sum("word_chars").alias("chars"),
        F.array(*[F.sum(c) for c in _CLASS_COUNTS]).alias("classes"),
        F.array(*[F.sum(F.get("own_times", F.lit(i))) for i in range(OWN_WORDS)]).alias("own")).where("chars > 0")
    # a language of fewer words has fewer shares
    own = F.transform(F.filter("own", lambda n: n.isNotNull()), lambda n: n / F.col("words"))
    known = sums.select(
        "lang", F.transform("classes", lambda n: n / F.col("chars")).alias("own_classes"),
        _let(own, lambda s: F.concat(s, F.array(1 - _total(s)))).alias("own_shares"))
    return counts.where("own_times is null").select("*", *none).unionByName(
        counts.where("own_times is not null").join(known, "lang", "left"))


def judged(counts: DataFrame, known: list[tuple[str, list[float], list[float]]]) -> DataFrame:
    """``counts`` of ``with_own_references`` with distances and verdicts.

    A document whose language has no reference has distances of 0.
    """
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})

    def shares(values: list[Column], whole: str) -> Column:
        return F.array(*[F.when(F.col(whole) > 0, v / F.col(whole)).otherwise(0.0) for v in values])

    def nearest(distances: list[Column], own: Column, reference: str) -> Column:
        """Over the fixed languages and, where it has a reference, the document's own."""
        fixed = F.least(*distances) if len(distances) > 1 else distances[0] if distances else F.lit(0.0)
        with_own = F.least(*distances, own) if distances else own
        return F.when(F.col("lang").isin([name for name, *_ in known]), fixed).when(
            F.col(reference).isNotNull(), with_own).otherwise(0.0)

    classes = shares([F.col(c) for c in _CLASS_COUNTS], "word_chars")

    def words(language: str) -> Column:
        own = [F.get("times", F.lit(listed.index(w))) for w in COMMON_WORDS[language]]
        return shares([*own, F.col("n_words") - reduce(lambda a, b: a + b, own)], "n_words")

    rest = F.col("n_words") - F.aggregate("own_times", F.lit(0).cast("bigint"), lambda a, x: a + x)
    own_shares = F.transform(F.concat("own_times", F.array(rest)), lambda n: F.when(
        F.col("n_words") > 0, n / F.col("n_words")).otherwise(0.0))
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    bare = nearest(
        [js_distance(literal([0] * (len(w) - 1) + [1]), literal(w)) for _, _, w in known],
        js_distance(F.transform("own_shares", lambda x, i: F.when(
            i == F.size("own_shares") - 1, 1.0).otherwise(0.0)), F.col("own_shares")), "own_shares")

    def limit(fixed: float, by_words: float) -> Column:
        return F.sqrt(fixed + by_words / F.col("n_words"))

    word_limit = F.least(limit(*WORD_LIMIT), F.greatest(BARE_SHARE * bare, F.lit(BARE_MIN)))
    return counts.withColumns({
        "class_distance": nearest(
            [js_distance(classes, literal(c)) for _, c, _ in known],
            js_distance(classes, F.col("own_classes")), "own_classes"),
        "word_distance": nearest(
            [js_distance(words(name), literal(w)) for name, _, w in known],
            js_distance(own_shares, F.col("own_shares")), "own_shares"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    }).withColumn("kept", ~F.col("base_failed") & ~(
        ((F.col("word_chars") >= CLASS_MIN_CHARS) & (F.col("class_distance") > limit(*CLASS_LIMIT)))
        | ((F.col("n_words") >= WORDS_MIN) & (F.col("word_distance") > word_limit))))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document its base counts, its distances and the verdict ``kept``.

    Words are runs of anything but ASCII white space. Null and empty texts have no
    words and fail the base rules. A document without a ``lang``, or of one without
    a reference, has distances of 0 and is left to the base rules. Repeated rows and null ids give rows of their own; other
    columns are ignored.
    """
    counts = staged(described(with_own_words(docs)), "quality-counts")
    return judged(with_own_references(counts), references(counts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "class_distance", "word_distance")
