"""Recognised lines: rebuilding them from words, second-tier triggers, reconciliation, injection flags, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions import text

LOW = 0.88
LINES_A_PAGE = 30
#: The phrases and role marks that flag an injection; and, this library's choice, six special characters in a row.
INJECTION = r"(?i)ignore\s+(?:all\s+)?previous|system\s+note|award\s+full\s+marks|you\s+are\s+now|disregard\s+the\b|new\s+instructions|\b(?:assistant|system):|[#=*%$&<>{}|~^@\\]{6,}"


def rebuild_lines(words: DataFrame) -> DataFrame:
    """(page, line, text, n_words) of words (page, word, x, y, w, h).

    Words in the order of their middles begin a new line where the step from the word before exceeds 0.6 of the
    page's median height; a line reads by x.
    """
    middle = words.join(words.groupBy("page").agg((F.percentile("h", 0.5) * 0.6).alias("gap")), "page").withColumn("cy", F.col("y") + F.col("h") / 2)
    by = W.partitionBy("page").orderBy("cy", "x", "word")
    begins = F.coalesce((F.col("cy") - F.lag("cy").over(by) > F.col("gap")).cast("int"), F.lit(0))
    lined = middle.withColumn("begins", begins).withColumn("line", F.sum("begins").over(by))
    ordered = F.array_sort(F.collect_list(F.struct("x", "word")))  # a written line's words
    return lined.groupBy("page", "line").agg(ordered.alias("ws")).select("page", "line", F.array_join(F.transform("ws", lambda s: s["word"]), " ").alias("text"), F.size("ws").alias("n_words"))


def near_misses(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(line, token, term): tokens one or two edits from a rubric term, and no term themselves.

    The lexicon is a rubric's; candidates share one of the pieces that such an edit must leave whole, so tokens
    meet terms by equal keys rather than all with all.
    """
    words = tokens.select("token").distinct().join(lexicon.select(F.col("term").alias("token")), "token", "left_anti")  # each token once
    sized = words.withColumn("size", F.explode(F.sequence(F.greatest(F.length("token") - 2, F.lit(1)), F.length("token") + 2)))
    keyed = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("shift", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    start = F.floor(F.col("part") * F.col("size") / 3) + F.col("shift") + 1
    length = F.floor((F.col("part") + 1) * F.col("size") / 3) - F.floor(F.col("part") * F.col("size") / 3)
    keyed = keyed.filter((start >= 1) & (start + length - 1 <= F.length("token"))).withColumn("key", F.substr("token", start.cast("int"), length.cast("int")))
    own = lexicon.select("term", F.length("term").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("part")).withColumn("key", piece(F.col("term"), F.col("part"), F.length("term")))
    found = keyed.join(own, ["size", "part", "key"]).select("token", "term").distinct()
    return tokens.select("line", "token").distinct().join(found.filter(F.levenshtein("token", "term").between(1, 2)), "token").select("line", "token", "term")


def piece(c: Column, i: Column, size: Column) -> Column:
    """The i-th third of a text."""
    a, b = F.floor(i * size / 3), F.floor((i + 1) * size / 3)
    return F.substr(c, (a + 1).cast("int"), (b - a).cast("int"))


def tier2(lines: DataFrame) -> DataFrame:
    """``red`` and ``sent`` for lines (page, line, text, confidence, spread, near_miss, struck).

    Weak, odd or flagged lines are sent; of more than LINES_A_PAGE on a page, the weakest.
    """
    red = F.array_compact(F.array(F.when(F.col("confidence") < LOW, "LOW"), F.when(F.col("near_miss"), "LEXICON"), F.when(F.col("text").rlike(r"[0-9]|[%°µ=+<>]"), "NUMERAL"), F.when(F.col("struck"), "STRUCK"), F.when(F.col("spread") > 0.25, "SPREAD"), F.when(F.col("text").rlike(INJECTION), "INJECTION")))
    flagged = lines.withColumn("red", red).withColumn("wanted", F.size("red") > 0)
    by = W.partitionBy("page", "wanted").orderBy("confidence", "line")
    return flagged.withColumn("sent", F.col("wanted") & (F.row_number().over(by) <= LINES_A_PAGE)).drop("wanted")


def reconcile(a: Column, b: Column) -> Column:
    """(source, text, confidence, flag) of two readings of a line; either may be missing or unreadable."""
    fa, fb = text.folded(a), text.folded(b)
    longer, errors = F.greatest(F.length(fa), F.length(fb)), text.char_errors(fa, fb)
    alike = lambda per_cent: (longer - errors) * 100 >= longer * per_cent  # noqa: E731  1 - errors / longer, in whole numbers
    unread = lambda c: c.isNull() | (F.upper(F.trim(c)) == "UNREADABLE")
    pick = lambda s, t, c, f: F.struct(F.lit(s).alias("source"), t.cast("string").alias("text"), F.lit(c).alias("confidence"), F.lit(f).cast("string").alias("flag"))
    return (
        F.when(unread(a) | unread(b), pick("UNRESOLVED", F.lit(None), 0.0, "NEEDS_HUMAN"))
        .when(fa == fb, pick("ARBITRATED", a, 0.95, None))
        .when(alike(92), pick("TIER2", b, 0.88, None))
        .when(alike(70), pick("BOTH", F.concat_ws(" / ", a, b), 0.60, "AMBIGUOUS"))
        .otherwise(pick("UNRESOLVED", F.lit(None), 0.0, "NEEDS_HUMAN"))
    )


def struck_through(x: Column, y: Column, width: Column, thickness: Column, line: Column) -> Column:
    """Whether a horizontal run strikes a line out: 60 per cent of its width, 1 to 4 pixels thick, in its middle 40 per cent.

    The run starts at x and its middle is at y; ``line`` is the line's box (x, y, w, h). What lies beyond the box doesn't count.
    """
    inside = F.least(x + width, line["x"] + line["w"]) - F.greatest(x, line["x"])
    place = y - line["y"]
    return F.coalesce((inside * 10 >= line["w"] * 6) & thickness.between(1, 4) & (place * 10 >= line["h"] * 3) & (place * 10 <= line["h"] * 7), F.lit(False))


def injection_flags(df: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """(key, hits) of texts with at least one hit; texts are flagged, never changed."""
    return df.select(*key, F.regexp_count(F.col(column), F.lit(INJECTION)).alias("hits")).filter("hits > 0")


def joined_lines(lines: DataFrame, key: str, order: str = "line") -> DataFrame:
    """(key, text): an answer's lines in reading order, without those that are struck through; lines (key, order, text, struck)."""
    kept = lines.filter(~F.coalesce("struck", F.lit(False)) & F.col("text").isNotNull())
    read = F.array_sort(F.collect_list(F.struct(order, "text")))  # an answer's lines
    return kept.groupBy(key).agg(read.alias("ls")).select(key, F.array_join(F.transform("ls", lambda s: s["text"]), "\n").alias("text"))


def sentences(df: DataFrame, key: str, column: str = "text", shortest: int = 4, most: int | None = 120) -> DataFrame:
    """(key, nth, sentence): hyphens at line ends repaired; cut before capitals on new lines, bullets and enumerators.

    A piece with fewer than ``shortest`` tokens joins what follows. An answer has at most ``most`` sentences, as
    the marking form does; None for whole documents.
    """
    joined = F.regexp_replace(F.col(column), r"(\p{L})-\n(\p{Ll})", "$1$2")
    pieces = F.filter(F.transform(F.split(joined, r"\n+(?=\p{Lu}|[-*•]|\(?[0-9a-z]{1,2}[.)])|(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    size = lambda s: F.size(F.split(s, " "))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, s: Column) -> Column:
        own = F.when(acc["held"] == "", s).otherwise(F.concat_ws(" ", acc["held"], s))
        full = size(own) >= shortest
        return F.struct(F.when(full, F.concat(acc["done"], F.array(own))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(own).alias("held"))

    folded = F.aggregate(pieces, zero, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))
    return df.select(key, F.posexplode(folded if most is None else F.slice(folded, 1, most)).alias("nth", "sentence"))


def expand(words: Column, abbreviations: Column) -> Column:
    """Tokens with abbreviations written out by a map; nothing is stemmed and negations stay."""
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(abbreviations, t), t))
