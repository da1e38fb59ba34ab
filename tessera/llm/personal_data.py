"""Personal data: pattern kinds, and bootstrapped contextual extraction of what no pattern describes.

The kinds with a fixed form (email, ip, card, phone) are seeds, and so are long hexadecimal keys. The words in front of them are
lexical patterns, which also stand in front of other identifier-like strings. A pattern is as good as the strings it extracts,
a string as good as the patterns that extract it: the two are scored in turn over the graph of distinct (pattern, string) pairs
until no score moves, and strings of a high score are personal data of the kind ``id``. A key is one only if patterns say so: a
checksum in a list of checksums shares its form, not its context. Everything is DataFrame functions; no Python runs on the
executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: Each finds what the plain form of its kind would find first, and starts at places where that could, so that long runs
#: are read once: local parts from their first character or behind the last match, numbers from their first digit.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like string: a run of characters without white space or quotes that holds six digits or more.
CANDIDATE = r"(?<![^\s\"'])(?=[^\s\"'0-9]*+[0-9])(?:[^\s\"'0-9]*+[0-9]){6,}+[^\s\"'0-9]*+"
#: A key that is a seed: digits of base 16, 32 or more in a row.
KEY = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
#: A pattern counts once it stands before so many different seeds; one that scores less is not believed, and a string is
#: taken over at this score. Scores only rise from round to round; the last round is the one that raises none by STABLE.
SUPPORT, BELIEVED, TAKEN, STABLE = 3, 0.5, 0.8, 0.01
#: Code points looked at for the two words in front of a span, as few as will do; in the end all of them are.
REACH = (60, 2000)
#: Long texts are searched in pieces of at least so many code points, each ending at the next place that no match can go across:
#: white space other than a blank, or a blank that stands behind what is no part of a number or before a plus sign.
PIECE = 1000
CUT = r"(?<=[\t\n\x0B\f\r])|(?<=[^\x20().0-9-]\x20)|(?<=\x20)(?=\+)"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\"']+"), lambda w: w != "")


def _last_two(words: Column) -> Column:
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))


def pieces(text: Column) -> Column:
    """array<struct<at, before, text>>: a text in pieces, where each starts, and the two words before it, fewer at the text's start.

    Everything further on looks at one piece at a time, so that time grows with the length of a text, but for pointers to its
    pieces, of which a list is copied for each. Null is the empty text, which is one piece.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    whole = F.array(F.struct(F.lit(0).alias("at"), none.alias("before"), text.alias("text")))
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{{PIECE}}}.*?(?:{CUT}|\z)|.+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), none.alias("before"), F.filter(whole, lambda x: F.lit(False)).alias("out"))

    def step(acc, x):
        out = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["before"].alias("before"), x.alias("text"))))
        return F.struct((acc["at"] + F.length(x)).alias("at"), _last_two(F.concat(acc["before"], _last_two(_words(x)))).alias("before"), out.alias("out"))

    long = (F.length(text) > 2 * PIECE) & F.rlike(text, F.lit("[0-9@]"))
    return F.when(long, F.aggregate(cut, start, step, lambda acc: acc["out"])).otherwise(whole)


def _found(text: Column, kind: str, pattern: str, valid) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's matches in text that are valid; code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Where each match starts: the gaps and matches before it. One pass over the matches, with a running position.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gaps"])
        end = begin + F.length(x["values"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["values"].alias("value")))
        return F.struct(end.alias("at"), F.when(valid(x["values"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(values.alias("values"), gaps.alias("gaps")), lambda x: x["values"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)

    def add(acc, i):
        digit = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    # Parts are compared as numbers whatever their length: without leading zeros, at most three digits.
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)),
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """The spans of the four kinds, in the order of the kinds and then of their starts. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPANS)
    may = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]")), "phone": F.contains(text, F.lit("+"))}
    return F.concat(*[F.when(may[k], _found(text, k, PATTERNS[k], VALID[k])).otherwise(none) for k in KINDS])


def _candidates(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the identifier-like strings, edge punctuation included."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPANS)
    return F.when(F.rlike(text, F.lit("[0-9]")), _found(text, "id", CANDIDATE, lambda x: F.lit(True))).otherwise(none)


def _context(text: Column, start: Column, earlier: Column) -> Column:
    """The lexical patterns in front of a span: the last word, and the last two, in lower case. Empty at a text's start.

    Words are whole, however long: a window that may have cut one of the two is widened. earlier has those before the text.
    """
    before = lambda reach: F.substr(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    words = _words(F.substr(text, F.lit(1), start))
    for reach in reversed(REACH):
        near = _words(before(reach))
        words = F.when((start <= reach) | (F.size(near) > 2), near).otherwise(words)
    words = F.concat(earlier, words)
    n = F.size(words)
    return F.filter(F.array(F.when(n >= 1, F.element_at(words, -1)), F.when(n >= 2, F.concat_ws(" ", F.slice(words, -2, 2)))), lambda p: p.isNotNull())


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))


def _seen(piece: Column) -> Column:
    """struct<base, seen> of a piece: its spans, and with their patterns all its strings that are or may be personal data."""
    text, at = piece["text"], piece["at"]
    both = F.struct(base_spans(text).alias("base"), _candidates(text).alias("found"))
    entry = lambda is_base: lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value"), _context(text, x["start"], piece["before"]).alias("patterns"), F.lit(is_base).alias("base"))

    def put(x):
        others = F.filter(x["found"], lambda c: ~F.exists(x["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        return F.struct(_shifted(x["base"], at).alias("base"), F.concat(F.transform(x["base"], entry(True)), F.transform(others, entry(False))).alias("seen"))

    # A list of one, so that the spans of a piece are found once and used by name.
    return F.element_at(F.transform(F.array(both), put), 1)


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column has."""
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def _learn(docs: DataFrame, scratch: Scratch, text_col: str, kept: list[str]) -> tuple[DataFrame, str, str]:
    """The columns kept of docs, and under the two names that are returned what each piece of a text holds, (base, seen), and the
    spans learnt, a map from a piece's number to its own, or null."""
    text = F.col(f"`{text_col}`").cast("string")
    row, own, ids = (_free(n, docs.columns) for n in ("row", "seen", "ids"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.transform(pieces(text), _seen).alias(own), F.monotonically_increasing_id().alias(row))
    rows = scratch.write(rows)
    strings = rows.select(F.col(row).alias("row"), F.posexplode(own).alias("piece", "p")).where(F.size("p.seen") > 0).select("row", "piece", F.explode("p.seen").alias("s")).select("row", "piece", "s.*")
    pairs = strings.select(F.explode("patterns").alias("pattern"), "value", "base").groupBy("pattern", "value").agg(F.max("base").alias("base"))
    pairs = scratch.write(pairs.withColumn("seed", F.col("base") | F.rlike("value", F.lit(KEY))))
    taken = scores(pairs, scratch).where(F.col("score") >= TAKEN).select("value")
    new = strings.where(~F.col("base")).join(taken, "value", "left_semi")
    new = new.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "end", "value"))).alias("spans"))
    # Written, so that Spark knows its size and need not shuffle the texts if it is small.
    new = scratch.write(new.groupBy(F.col("row").alias("of")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("piece", "spans")))).alias("spans")))
    new = new.withColumnsRenamed({"of": (of := _free("of", rows.columns)), "spans": ids})
    return rows.join(new, F.col(row) == F.col(of), "left").drop(row, of), own, ids


def scores(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, score) of the strings in pairs (pattern, value, base, seed), a row for each distinct pattern and value.

    A pattern's trust is the mean score of the strings behind it, one failure added; it counts if SUPPORT seeds are behind it and it
    is BELIEVED. A string's score is the chance that not all of its patterns are wrong. The two are computed in turn until no score rises by
    STABLE. Strings that are base spans have none.
    """
    score = None
    while True:
        now = pairs.withColumn("score", F.col("seed").cast("double")) if score is None else pairs.join(score, "value", "left").withColumn("score", F.greatest(F.col("seed").cast("double"), F.coalesce("score", F.lit(0.0))))
        patterns = now.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        patterns = patterns.where((F.col("seeds") >= SUPPORT) & (F.col("trust") >= BELIEVED)).select("pattern", "trust")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        raised = scratch.write(pairs.where(~F.col("base")).join(patterns, "pattern").groupBy("value").agg((1 - wrong).alias("score")))
        rise = F.col("score") - (F.lit(0.0) if score is None else F.coalesce("before", F.lit(0.0)))
        moved = raised if score is None else raised.join(score.withColumnRenamed("score", "before"), "value", "left")
        settled = moved.where(rise >= STABLE).isEmpty()
        score = raised
        if settled:
            return score


def find(docs: DataFrame, scratch: Scratch, text_col: str = "text", keep_text: bool = True, into: tuple[str, str] = ("pii_base", "pii_id")) -> DataFrame:
    """docs, with or without their texts, with pii_base and pii_id (or ``into``), arrays of (kind, start, end, value) in order of kind and start.

    What is learnt has six digits or more and neither white space nor quotes in it; a pattern stands before three different seeds
    or more. Null and empty texts hold nothing. Repeated rows each get their spans. Columns of those two names are replaced, and
    all others are left as they are. An empty table stays one. What is learnt is learnt from all documents: the graph has a
    row for each distinct pair of pattern and string, summed before it is shuffled. Long texts take time in proportion to their
    length, unless they go on for thousands of characters without a place where a number must end.
    """
    base, learnt = into
    kept = [c for c in docs.columns if c not in into and (keep_text or c != text_col)]
    rows, own, ids = _learn(docs, scratch, text_col, kept)
    by_kind = F.concat(*[F.flatten(F.transform(own, lambda p: F.filter(p["base"], lambda s: s["kind"] == k))) for k in KINDS])  # noqa: B023
    return rows.select(*[F.col(f"`{c}`") for c in kept], by_kind.alias(base), F.coalesce(F.flatten(F.map_values(ids)), F.array().cast(SPANS)).alias(learnt))


def redact(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    rows, own, ids = _learn(docs, scratch, text_col, docs.columns)
    text = F.col(f"`{text_col}`").cast("string")
    parts = F.transform(F.arrays_zip(pieces(text).alias("piece"), F.col(own).alias("held")), lambda x, i: F.struct(x["piece"].alias("piece"), x["held"]["base"].alias("base"), F.element_at(ids, i).alias("ids")))

    def clean(part):
        piece, at = part["piece"]["text"], part["piece"]["at"]
        spans = F.concat(part["base"], F.coalesce(part["ids"], F.array().cast(SPANS)))
        spans = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - at).alias("start"), (s["end"] - at).alias("end"), s["kind"].alias("kind"))))

        def step(acc, s):
            kept = F.substr(piece, acc["at"] + 1, s["start"] - acc["at"])
            mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(kept, mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(spans, begin, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substr(piece, acc["at"] + 1, F.length(piece))))

    hit = F.exists(own, lambda p: F.size(p["base"]) > 0) | F.col(ids).isNotNull()
    out = F.when(hit, F.concat_ws("", F.transform(parts, clean))).otherwise(F.col(f"`{text_col}`"))
    return rows.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _join(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("bigint")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "personal-data")
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch, keep_text=False)
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_join(F.col("pii_base")), 256).alias("base_sha256"),
        _join(F.concat("pii_base", "pii_id")).alias("spans"), F.size("pii_id").cast("bigint").alias("n_id"),
    )
