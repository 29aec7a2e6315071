"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document: bad beyond a threshold, good well
within it, nothing between the two or where a rule doesn't apply. How far a rule can be trusted is not
known: expectation-maximisation estimates, from the votes alone, how often each rule accuses a bad and
a good document when it votes, and the share of good documents. A document's posterior probability of
being good then decides, not the agreement of all rules: a rule that accuses often by mistake counts
little, and a document that it accuses is kept where the others speak for it.

Abstentions say nothing (they depend on a text's length and form). No two rules look at the same
characters, so they may count as independent. The estimate goes on until the likelihood stands still;
its prior is PSEUDO votes a rule, so it is the documents that count. What votes alone can't tell is
a defect that a single rule sees and that has nothing to do with the others' from that rule's mistakes.

Votes are counted by pattern before anything leaves the executors. There are at most
3 ** len(RULES) patterns however many documents there are, so the estimation on the driver is
bounded; the posterior is a table lookup by pattern with the same bound.

Edge cases: a null text has no words; documents without words fail the base rule; texts of any length
are judged by ratios alone; repeated rows are judged each on its own; an empty table gives an empty
result; documents without any vote have the share of good documents as their probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_pass, stage, texts_of, unused

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_letters", "n_upper", "n_digits", "n_distinct", "n_marks", "n_ended", "n_punct")

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCT = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, the first included; number of distinct words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) < 4:
        return 0, len(number)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # keeps the windows' numbers below 2 ** 63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0, len(number)
    often = np.zeros(len(windows), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= often
    return int(covered.sum()), len(number)


def measures(text: str) -> tuple[int, ...]:
    """COUNTS and MORE of a text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats, distinct = repeated_words(words)
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b";", b'"') for x in lines)
    return (
        len(words), len(text) - _count(raw, b" \t\n\x0b\x0c\r"), _count(raw, b"#*$%&|<>"), len(lines) - len(set(lines)), repeats,
        len(lines), _count(raw, _LETTERS), _count(raw, _UPPER), _count(raw, b"0123456789"), distinct, raw.count(b"!"), ended, _count(raw, _PUNCT),
    )


def with_measures(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs, all columns, with COUNTS and MORE of text after them, their names after prefix."""
    names = [*docs.columns, *(prefix + x for x in (*COUNTS, *MORE))]
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(*(measures(x) for x in texts_of(batch.column(at))), strict=True)
        yield pa.record_batch([*batch.columns, *(pa.array(x, pa.int64()) for x in rows)], names=names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names[len(docs.columns) :])])
    return arrow_pass(docs, work, schema)


def document_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, MORE) of each row."""
    return with_measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")


def base_failed(prefix: str = "") -> Column:
    n, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * repeats > 50 * n)


def _vote(of: Column, good: float, bad: float, applies: Column | None = None) -> Column:
    """A vote on a ratio: good up to one bound, bad beyond the other; the other way round where good is the larger."""
    vote = F.when(of > bad, -1).when(of <= good, 1) if good < bad else F.when(of < bad, -1).when(of >= good, 1)
    return (vote if applies is None else F.when(applies, vote)).cast("int")


def rules(prefix: str = "") -> dict[str, Column]:
    """The rules by name, as votes over with_measures()."""

    def c(name: str) -> Column:
        return F.col(prefix + name).cast("double")

    n = F.greatest(c("n_words"), F.lit(1.0))
    chars, lines = F.greatest(c("word_chars"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    letters = F.greatest(c("n_letters"), F.lit(1.0))
    votes = {
        "symbols": _vote(c("n_symbols") / n, 0.02, 0.1),
        "repeats": _vote(c("n_repeat_words") / n, 0.1, 0.3),
        "lines": _vote(c("n_dup_lines") / lines, 0.1, 0.35, lines >= 4),
        "shouting": _vote(c("n_upper") / letters, 0.1, 0.3),
        "marks": _vote(c("n_marks") / n, 0.05, 0.2),
        "punctuation": _vote((c("n_punct") - c("n_symbols") - c("n_marks")) / chars, 0.045, 0.08),
        "digits": _vote(c("n_digits") / chars, 0.1, 0.3),
        # Distinct words by a power of all words, as a text's vocabulary grows.
        "variety": _vote(F.log(F.greatest(c("n_distinct"), F.lit(1.0))) / F.log(F.greatest(n, F.lit(2.0))), 0.8, 0.6, n >= 30),
        "word_length": _vote(F.abs(F.log(chars / n / 5.2)), 0.2, 0.35),
        "endings": _vote(c("n_ended") / lines, 0.97, 0.9),
    }
    return {name: F.coalesce(vote, F.lit(0)) for name, vote in votes.items()}


#: Before any document is seen: how often a rule accuses a bad and a good document, as so many votes; and the share of good documents.
PRIOR, PSEUDO, GOOD = (0.3, 0.02), 4.0, 0.8


def fit(votes: np.ndarray, counts: np.ndarray, tolerance: float = 1e-12) -> tuple[float, np.ndarray]:
    """EM over vote patterns (patterns x rules, -1/0/1) with their counts.

    Returns the share of good documents and accuse[class, rule], the chance that a rule that votes
    votes bad; class 0 is bad. Ends where the likelihood, with the prior, grows by no more than tolerance of itself.
    """
    prior, bad, voted = np.array(PRIOR)[:, None], (votes == -1).astype(float), (votes != 0).astype(float)
    share, accuse, before = GOOD, np.repeat(prior, votes.shape[1], axis=1), -np.inf
    while True:
        score = _scores(votes, share, accuse)
        top = score.max(axis=0)
        whole = top + np.log(np.exp(score - top).sum(axis=0))
        likely = float(counts @ whole + PSEUDO * (prior * np.log(accuse) + (1 - prior) * np.log1p(-accuse)).sum() + PSEUDO * (GOOD * np.log(share) + (1 - GOOD) * np.log1p(-share)))
        if likely - before <= tolerance * abs(likely):
            return share, accuse
        before = likely
        mass = np.exp(score - whole) * counts
        accuse = np.clip((mass @ bad + PSEUDO * prior) / (mass @ voted + PSEUDO), 1e-12, 1 - 1e-12)
        share = float((mass[1].sum() + PSEUDO * GOOD) / (counts.sum() + PSEUDO))


def _scores(votes: np.ndarray, share: float, accuse: np.ndarray) -> np.ndarray:
    """Log probabilities (class, pattern) of a class and its votes."""
    bad, good = (votes == -1).astype(float), (votes == 1).astype(float)
    return np.log([[1 - share], [share]]) + np.log(accuse) @ bad.T + np.log1p(-accuse) @ good.T


def posterior(votes: np.ndarray, share: float, accuse: np.ndarray) -> np.ndarray:
    """Of each pattern: the probability that a document with these votes is good."""
    score = _scores(votes, share, accuse)
    return 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))


def votes_code(prefix: str = "") -> Column:
    """The rules' votes as one number: vote + 1 as digits to base 3."""
    return sum(((v + 1) * 3**i for i, v in enumerate(rules(prefix).values())), F.lit(0)).cast("int")


def qualities(measured: DataFrame, prefix: str = "") -> DataFrame:
    """(votes, quality): each vote pattern in measured with the posterior that the fit gives it.

    Documents that fail the base rule are rejected whatever their votes, so the fit leaves them out.
    """
    judged = measured.filter(~base_failed(prefix)).select(votes_code(prefix).alias("votes"))
    seen = judged.groupBy("votes").count().collect()  # 3 ** len(rules()) rows at most
    spark = measured.sparkSession
    if not seen:
        return spark.createDataFrame([], "votes int, quality double")
    codes = np.array([r["votes"] for r in seen], dtype=np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(rules()))], axis=1)
    share, accuse = fit(patterns, np.array([r["count"] for r in seen], dtype=float))
    return spark.createDataFrame(list(zip(codes.tolist(), posterior(patterns, share, accuse).tolist(), strict=True)), "votes int, quality double")


def quality_report(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, COUNTS, base_failed, quality, kept) of each row; kept: not base_failed, and quality >= least.

    quality is null where no document passes the base rule with the same votes.
    """
    measured = stage(document_measures(docs), "quality")
    judged = measured.withColumn("votes", votes_code()).join(F.broadcast(qualities(measured)), "votes", "left")
    kept = ~base_failed() & (F.coalesce("quality", F.lit(0.0)) >= least)
    return judged.select("doc_id", *COUNTS, base_failed().alias("base_failed"), "quality", kept.alias("kept"))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that quality_report() keeps.

    Documents are measured once for the votes and once more to filter, so texts are never shuffled.
    """
    (prefix,) = unused(docs, "_quality_")
    votes, posterior_ = f"{prefix}votes", f"{prefix}posterior"
    table = qualities(document_measures(docs)).withColumnsRenamed({"votes": votes, "quality": posterior_})
    measured = with_measures(docs, prefix).withColumn(votes, votes_code(prefix))
    good = measured.join(F.broadcast(table), votes).filter(~base_failed(prefix) & (F.col(posterior_) >= least))
    return good.select(*(F.col(f"`{x}`") for x in docs.columns))
