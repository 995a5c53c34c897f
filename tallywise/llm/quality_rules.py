"""Quality rules combined by weak supervision.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains
(0).  No rule decides alone.  Expectation-maximisation estimates, for either
class, how often each rule that votes is right, and the share of good documents;
an abstention says nothing.  A document is kept if its posterior probability of being good reaches
``threshold``.

The estimate needs only how many documents share a pattern of votes.  With eight
rules there are at most 3**8 patterns, so one counting pass feeds all rounds,
whatever the size of the input, and the posteriors are a table of that many rows.

Nulls and edge cases: a null or blank text has no words, so it votes as an empty
one and fails the base checks; a null id is returned as it came; rows that repeat
are counted and judged one by one; an empty table gives no rows.  Only the id and
text columns are used, other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, materialise, words

#: Common function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in a is that it for on was as with be by are this at from an "
    "de la le les des et que un une en du est qui dans pour par "
    "el los las y se del con una su para "
    "der die das und ist von mit zu den sich ein eine für im").split()

#: name, vote good, vote bad; both over the counts that ``measure`` returns.
RULES = [
    ("length", "n_words >= 40", "n_words < 10"),
    ("word_length", "10 * word_chars BETWEEN 30 * n_words AND 90 * n_words",
     "10 * word_chars < 20 * n_words OR 10 * word_chars > 140 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > 3 * n_words"),
    ("lines", "n_dup_lines = 0 AND n_lines >= 3", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "20 * n_repeat_words <= n_words AND n_words >= 20", "100 * n_repeat_words > 20 * n_words"),
    ("function_words", "100 * n_function_words >= 12 * n_words", "100 * n_function_words < 4 * n_words AND n_words >= 20"),
    ("letters", "100 * n_letters >= 88 * word_chars", "100 * n_letters < 70 * word_chars"),
    ("capitals", "100 * n_capitals <= 25 * n_letters", "100 * n_capitals > 60 * n_letters"),
]
ROUNDS = 25
#: Pseudo-count of each answer, so no rule is ever certain.
SMOOTHING = 1.0
#: Where the rounds start: the chance of being good without and with a bad vote.
START = (0.9, 0.2)


def _repeat_words() -> str:
    """Words that lie in a five-word window found twice or more in the text."""
    window = ", ".join(f"w[i + {j}]" for j in range(5))
    order = "sort_array(transform(g, (h, i) -> struct(h AS h, i AS i)))"
    # Positions of windows whose neighbour in hash order is equal.
    found = ("sort_array(transform(filter(sequence(0, size(s) - 1), "
             "j -> coalesce(get(s, j - 1).h = s[j].h, false) OR coalesce(get(s, j + 1).h = s[j].h, false)), "
             "j -> s[j].i))")
    covered = ("aggregate(sequence(0, size(p) - 1), 0L, "
               "(a, j) -> a + least(5, coalesce(get(p, j + 1) - p[j], 5)))")
    count = let(order, "s", let(found, "p", covered))
    body = f"IF(size(array_distinct(g)) = size(g), 0L, {count})"
    hashes = f"transform(sequence(0, size(w) - 5), i -> xxhash64({window}))"
    return f"IF(size(w) < 6, 0L, {let(hashes, 'g', body)})"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules read, one row per document.

    Equal windows are found by 64-bit hashes within one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words(F.col(text_col)).alias("w"))
    split = split.withColumns({
        "joined": F.array_join("w", ""),
        "rows": F.filter(F.split("t", "\n"), lambda x: x.rlike(GAP.replace("[", "[^"))),
    })
    # Filters on a generated row stay above it: pushed into the counts, they would split the text anew for each word.
    return split.select("doc_id", F.inline(F.array(F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        F.regexp_count("joined", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("rows").cast("long").alias("n_lines"),
        (F.size("rows") - F.size(F.array_distinct("rows"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words()).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
        F.length(F.regexp_replace("joined", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("joined", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals")))))


def votes(measured: DataFrame) -> DataFrame:
    """Adds one ``vote_<rule>`` column per rule and ``pattern``, the votes as one number."""
    out = measured.withColumns({f"vote_{name}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")
                                for name, good, bad in RULES})
    code = sum(((F.col(f"vote_{name}") + 1) * 3 ** k for k, (name, _, _) in enumerate(RULES)), F.lit(0))
    return out.withColumn("pattern", code.cast("int"))


def posteriors(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, n, quality): the posterior of each pattern of votes, at most 3**rules rows."""
    k = len(RULES)
    counted = voted.groupBy("pattern", *[f"vote_{name}" for name, _, _ in RULES]).agg(F.count("*").alias("n"))
    counted = counted.select("pattern", F.array(*[F.col(f"vote_{name}") for name, _, _ in RULES]).alias("v"),
                             F.col("n").cast("double").alias("n"))
    # One row holds all patterns: bounded by 3**rules, not by the input.
    state = counted.agg(F.sort_array(F.collect_list(F.struct("pattern", "v", "n"))).alias("ps"))
    good, bad = START
    begin = f"transform(ps, p -> IF(array_contains(p.v, -1), {bad}D, {good}D))"
    total = "aggregate(zip_with(ps, {q}, (p, x) -> {what}), 0D, (a, b) -> a + b)"

    def answers(q: str, weight: str) -> str:
        share = total.format(q=q, what=f"IF(p.v[k] = v, p.n * {weight}, 0D)")
        return (f"transform(sequence(0, {k - 1}), k -> transform(array(-1, 0, 1), "
                f"v -> {share} + {SMOOTHING}D))")

    odds = (f"ln(g / b) + aggregate(sequence(0, {k - 1}), 0D, (a, r) -> a + IF(p.v[r] = 0, 0D, "
            "ln(yes[r][p.v[r] + 1] / (yes[r][0] + yes[r][2])) - ln(no[r][p.v[r] + 1] / (no[r][0] + no[r][2]))))")
    update = f"transform(ps, p -> 1D / (1D + exp(-({odds}))))"
    step = let(f"{total.format(q='q', what='p.n * x')} + {SMOOTHING}D", "g",
               let(f"{total.format(q='q', what='p.n * (1D - x)')} + {SMOOTHING}D", "b",
                   let(answers("q", "x"), "yes", let(answers("q", "(1D - x)"), "no", update))))
    fitted = state.select("ps", F.expr(f"aggregate(sequence(1, {rounds}), {begin}, (q, t) -> {step})").alias("q"))
    return fitted.select(F.explode(F.arrays_zip("ps", "q")).alias("x")) \
        .select("x.ps.pattern", F.col("x.ps.n").cast("long").alias("n"), F.col("x.q").alias("quality"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
          rounds: int = ROUNDS) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    voted = materialise(votes(measure(docs, id_col, text_col)), "votes")
    quality = F.broadcast(posteriors(voted, rounds).select("pattern", "quality"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.join(quality, "pattern", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[f"vote_{name}" for name, _, _ in RULES],
        failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= threshold)).alias("kept"))


def reject_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the rules reject; columns and rows are otherwise unchanged.

    The verdict depends on the row's own votes alone, so each row is judged where
    it lies and only the bounded table of posteriors is sent to it.
    """
    quality = posteriors(votes(measure(docs, id_col, text_col)))
    kept = quality.filter(F.col("quality") >= threshold).select("pattern")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = votes(measure(rows.select("row", F.col(f"row.`{text_col}`").alias("text")), "row", "text"))
    judged = judged.filter("n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words")
    return judged.join(F.broadcast(kept), "pattern", "left_semi") \
        .select(*[F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns])


def oracle() -> str:
    """The whole operator as DuckDB SQL; each round of the estimate is a pair of CTEs."""
    names = [name for name, _, _ in RULES]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(FUNCTION_WORDS))
    head = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
m AS MATERIALIZED (SELECT d.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_function_words,
  length(regexp_replace(array_to_string(w, ''), '[^\\p{{L}}]+', '', 'g')) AS n_letters,
  length(regexp_replace(array_to_string(w, ''), '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals
  FROM d JOIN l USING (r) LEFT JOIN c USING (r)),
v AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{n}"
                                        for n, good, bad in RULES)} FROM m),
p AS MATERIALIZED (SELECT {", ".join(f"vote_{n}" for n in names)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
q0 AS MATERIALIZED (SELECT *, CASE WHEN least({", ".join(f"vote_{n}" for n in names)}) = -1
  THEN {START[1]} ELSE {START[0]} END::DOUBLE AS q FROM p)"""
    s = SMOOTHING
    for i in range(1, ROUNDS + 1):
        sums = ", ".join(f"sum(CASE WHEN vote_{n} = {x} THEN n * {y} ELSE 0 END) + {s} AS {side}_{n}_{x + 1}"
                         for n in names for x in (-1, 1) for side, y in (("y", "q"), ("b", "(1 - q)")))
        pick = " + ".join(
            f"CASE vote_{n} " + " ".join(f"WHEN {x} THEN ln(y_{n}_{x + 1} / (y_{n}_0 + y_{n}_2)) "
                                         f"- ln(b_{n}_{x + 1} / (b_{n}_0 + b_{n}_2))" for x in (-1, 1))
            + " ELSE 0 END" for n in names)
        head += f""",
a{i} AS MATERIALIZED (SELECT sum(n * q) + {s} AS g, sum(n * (1 - q)) + {s} AS b, {sums} FROM q{i - 1}),
q{i} AS MATERIALIZED (SELECT {", ".join(f"vote_{n}" for n in names)}, n,
  1 / (1 + exp(-(ln(g / b) + {pick}))) AS q FROM q{i - 1}, a{i})"""
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return head + f""" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {failed} AS base_failed, NOT {failed} AND q >= 0.5 AS kept, round(q, 4) AS quality
FROM v JOIN q{ROUNDS} USING ({", ".join(f"vote_{n}" for n in names)})"""
