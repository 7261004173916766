"""Problem 8: texts cut off by field limits or broken transfers.

Positives are made by cutting intact texts at random places and at the length
limits of their source; a hashed logistic regression on closing characters,
closing words, punctuation and the distance to a limit is trained on them and
scores every record. Limits are not given: a limit of a source is a length at
and shortly below which far more texts end than at the lengths around it.
"""

from __future__ import annotations

import html
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_within, written

#: Closing characters of a text that the features are made of.
TAIL = 320
BITS = 16
#: A cut text may have lost up to so many characters more, at a word's border.
SLACK = 8
ELLIPSES = ("...", "…", " ...", " …")
#: What a broken transfer may leave behind the text: parts of a tag, part of a character.
REMAINS = ("<a hre", "<a", "<", "\ufffd")
_DOTS = re.compile(r"\s*(\.\.\.|…)\s*$")
_WORD = re.compile(r"[^\s]+")
ENDS = ".!?。؟"
QUOTES = "\"'”“»«’)」』"
#: A line is running text if a sentence ends it so many characters behind the cut at most.
LINE = 5_000
_PUNCT = ".,;:!?…·|«»“”„\"'()[]。、؟"


def _sizes(text: str = "text"):
    """A text's length in both measures fields are limited by."""
    return F.array(F.struct(F.lit("chars").alias("measure"), F.length(text).alias("n")), F.struct(F.lit("bytes").alias("measure"), F.octet_length(text).alias("n")))


def length_limits(docs: DataFrame, source: str = "source", text: str = "text", around: int = 150, excess: float = 5.0, least: int = 8) -> DataFrame:
    """`source, measure, n, limit_gap, chance, limit`: the lengths, in characters
    or bytes, that lie at most SLACK below a limit of their source, the
    distance, and the share of texts expected there anyway. Counted are different
    texts, so a page delivered often is no limit. A limit has at least
    `least` texts at it or up to SLACK below, more than `excess` times as many
    as the lengths up to `around` away suggest, and more than any length near it."""
    counts = (
        docs.where(F.length(text) > 0).select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(text).alias("h"), _sizes(text).alias("sizes"))
        .dropDuplicates(["source", "h"]).select("source", F.explode("sizes").alias("x"))
        .groupBy("source", "x.measure", "x.n").agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    by_n = Window.partitionBy("source", "measure").orderBy("n")
    near = F.sum("c").over(by_n.rangeBetween(-SLACK, 0))
    wide = F.sum("c").over(by_n.rangeBetween(-around, around)) - F.sum("c").over(by_n.rangeBetween(-SLACK, SLACK))
    expected = (wide + 1) * (SLACK + 1) / (2 * (around - SLACK))
    marked = counts.withColumn("near", near).withColumn("expected", expected).withColumn("most", F.max("c").over(by_n.rangeBetween(-SLACK, SLACK)))
    limits = marked.where((F.col("near") >= least) & (F.col("near") > excess * F.col("expected")) & (F.col("c") == F.col("most")) & (F.col("c") >= 2))
    return (
        limits.select("source", "measure", F.col("n").alias("limit"), (F.col("expected") / F.col("near")).alias("chance"), F.explode(F.sequence(F.lit(0), F.lit(SLACK))).alias("limit_gap"))
        .groupBy("source", "measure", (F.col("limit") - F.col("limit_gap")).alias("n"))
        .agg(F.min("limit_gap").alias("limit_gap"), F.min("chance").alias("chance"), F.max("limit").alias("limit"))
    )


def _with_gap(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` (`source, n, bytes`, source not null) and `limit_gap`, the lesser one of both measures, -1 if no limit is near."""
    for measure, column in (("chars", "n"), ("bytes", "bytes")):
        near = limits.where(F.col("measure") == measure).select(F.col("source").alias("_s"), F.col("n").alias("_n"), F.col("limit_gap").alias(f"_{measure}"))
        rows = rows.join(broadcast_within(near, 100_000), (F.col("source") == F.col("_s")) & (F.col(column) == F.col("_n")), "left").drop("_s", "_n")
    return rows.withColumn("limit_gap", F.coalesce(F.least("_chars", "_bytes"), F.lit(-1))).drop("_chars", "_bytes")


class Closings:
    """How often words, and groups of three signs, stand inside text and at the
    end of a line or sentence; hashed counts over the training tails."""

    SIZE = 1 << 18

    def __init__(self, tails: list[str]):
        self._add([self.places(t) for t in tails])

    @classmethod
    def from_places(cls, places: list[tuple[np.ndarray, np.ndarray]]) -> Closings:
        out = cls.__new__(cls)
        out._add(places)
        return out

    def _add(self, places: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.words, self.signs = (
            np.bincount(np.concatenate([p[i] for p in places]) if places else np.zeros(0, np.int64), minlength=2 * self.SIZE).reshape(2, self.SIZE).astype(np.int32) for i in (0, 1)
        )

    @classmethod
    def places(cls, tail: str) -> tuple[np.ndarray, np.ndarray]:
        """Where one tail counts: of its words and of its groups of signs the slots, plus SIZE where they close."""
        words: list[int] = []
        signs: list[int] = []
        *lines, last = tail.split("\n")
        for line in lines:  # what the last line ends with is what is to be judged
            cls._count(line, True, words, signs)
        cls._count(last, False, words, signs)
        return np.array(words, np.int64), np.array(signs, np.int64)

    @classmethod
    def _count(cls, line: str, whole: bool, words: list[int], signs: list[int]) -> None:
        found = _WORD.findall(line)
        for i, w in enumerate(found[1:] if whole else found[1:-1], 1):
            last = whole and i == len(found) - 1
            words.append(cls._slot(w.strip(_PUNCT)) + cls.SIZE * (last or w[-1] in ENDS))
        body = line.rstrip()
        if len(body) > 3:
            signs += [cls._slot(body[i - 3 : i]) + cls.SIZE * (body[i] in ENDS) for i in range(3, len(body))]
            if whole:
                signs.append(cls._slot(body[-3:]) + cls.SIZE)

    @classmethod
    def of(cls, words: np.ndarray, signs: np.ndarray) -> Closings:
        out = cls.__new__(cls)
        out.words, out.signs = words, signs
        return out

    @classmethod
    def _slot(cls, x: str) -> int:
        return zlib.crc32(x.encode("utf-8", "surrogatepass")) & (cls.SIZE - 1)

    @staticmethod
    def _level(inner: int, final: int) -> str:
        seen = inner + final
        share = final / seen if seen else 0
        return f"{min(seen, 1) + (seen > 3) + (seen > 30)}/{0 if final == 0 else 1 if share < 0.05 else 2 if share < 0.3 else 3}"

    def levels(self, word: str, signs: str) -> tuple[str, str]:
        w, c = self._slot(word), self._slot(signs)
        return self._level(self.words[0, w], self.words[1, w]), self._level(self.signs[0, c], self.signs[1, c])


_MASK = (1 << BITS) - 1


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & _MASK for x in names]


def own_features(tail: str, n_chars: int, limit_gap: int) -> tuple[list[int], tuple]:
    """Hashed features of one record that need nothing but the record, and what
    `closing_features` needs. `limit_gap`: characters below a limit, -1 if none is near."""
    bare = _DOTS.sub("", tail.rstrip())
    dots = len(bare) < len(tail.rstrip())
    line = bare.rsplit("\n", 1)[-1]
    words = _WORD.findall(line)
    last = words[-1] if words else ""
    end = bare[-1:] or "∅"
    kind = "l" if end.islower() else "u" if end.isupper() else "d" if end.isdigit() else "o" if end.isalpha() else end
    gap = "no" if limit_gap < 0 else "at" if limit_gap == 0 else "near" if limit_gap <= 3 else "below"
    letters = "".join(ch for ch in last if ch.isalpha())
    f = [
        "bias", f"end={end}", f"kind={kind}", f"dots={dots}", f"dots={dots},{gap}", f"gap={gap}", f"gap={gap},{kind}", f"space={tail[-1:].isspace()}",
        f"word={last}", f"size={min(len(letters), 12)},{kind}", f"words={min(len(words), 14)},{kind}", f"short={n_chars < 60}",
        f"inner={any(w[-1] in '.!?。؟' for w in words[:-1])},{kind}", f"sign={'·' in line},{'|' in line},{'—' in line},{'%' in line}",
        f"first={words[0][:1].isupper() if words else ''},{kind},{min(len(words), 9)}", f"tag={'<' in bare[-12:]}", f"broken={'\ufffd' in bare[-2:]}",
    ]
    f += _structure(bare, line, words, kind)
    f += [f"c{k}={bare[-k:]}" for k in (2, 3, 4, 5, 6, 8)]
    f += [f"w2={' '.join(words[-2:])}", f"w3={' '.join(words[-3:])}"] if len(words) > 1 else []
    return _hashed(f), (last.strip(_PUNCT), bare[-3:], kind, gap)


def closing_features(ends: tuple, closings: Closings) -> list[int]:
    """Hashed features of how often a record's last word and signs close a line."""
    word, signs, kind, gap = ends
    word_level, sign_level = closings.levels(word, signs)
    return _hashed([f"known={word_level},{kind}", f"known={word_level},{gap}", f"signs={sign_level},{kind}", f"both={word_level},{sign_level},{kind}"])


def features(tail: str, n_chars: int, limit_gap: int, closings: Closings) -> list[int]:
    """All hashed features of one record."""
    own, ends = own_features(tail, n_chars, limit_gap)
    return own + closing_features(ends, closings)


def _structure(bare: str, line: str, words: list[str], kind: str) -> list[str]:
    """How the lines before the last one end: an item of a list, a headline or a row of a table stands among its like."""
    before = [x for x in (y.strip() for y in bare.split("\n")[:-1]) if x]
    open_lines = 0
    for x in reversed(before):
        if x.rstrip(QUOTES)[-1:] in ENDS:
            break
        open_lines += 1
    prev = before[-1] if before else ""
    last = "none" if not before else "open" if open_lines else "end"
    inner = any(w.rstrip(QUOTES)[-1:] in ENDS for w in words[:-1]) or any(ch in "。؟" for ch in line[:-1])
    size = min(len(line) // 12, 9)
    closed = line.rstrip(QUOTES + " ")[-1:] in ENDS
    digits = sum(ch.isdigit() for ch in line) * 4 // max(len(line), 1)
    return [
        f"prev={last},{kind}", f"open={min(open_lines, 4)},{inner}", f"open={min(open_lines, 4)},{inner},{size}", f"open={min(open_lines, 4)},{len(prev) // 12 if len(prev) < 96 else 8},{inner}",
        f"inner2={inner},{size},{kind}", f"head={prev if len(prev) <= 24 else ''}", f"line={line.strip() if len(line) <= 40 else ''}", f"only={not before},{size},{closed}", f"digits={digits},{min(open_lines, 2)}", f"closed={closed},{inner}", f"closed={closed},{kind}", f"blank={bool(before) and bare[: -len(line) or None].endswith('\n\n')},{last},{inner}",
    ]


def feature_rows(own: list[tuple[list[int], tuple]], closings: Closings) -> tuple[np.ndarray, np.ndarray]:
    """All features end to end, and the row of each, from the records' own ones."""
    rows = [f + closing_features(ends, closings) for f, ends in own]
    return np.fromiter((x for r in rows for x in r), np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def own_rows(tails: list[str], n_chars: np.ndarray, gaps: np.ndarray) -> list[tuple[list[int], tuple]]:
    return [own_features(t, int(n), int(g)) for t, n, g in zip(tails, n_chars, gaps, strict=True)]


def fit(own: list[tuple[list[int], tuple]], y: np.ndarray, closings: Closings, epochs: int = 12, rate: float = 0.15, l2: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Logistic regression by Adagrad over shuffled minibatches."""
    idx, row = feature_rows(own, closings)
    start = np.searchsorted(row, np.arange(len(y) + 1))
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(order), 256):
            take = order[b : b + 256]
            count = start[take + 1] - start[take]
            at = idx[np.repeat(start[take] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            of = np.repeat(np.arange(len(take)), count)
            p = 1 / (1 + np.exp(-np.bincount(of, w[at], len(take))))
            touched, inverse = np.unique(at, return_inverse=True)
            grad = np.bincount(inverse, (p - y[take])[of], len(touched)) + l2 * len(take) * w[touched]
            g2[touched] += grad * grad
            w[touched] -= rate * grad / np.sqrt(g2[touched])
    return w


def score(model: tuple[np.ndarray, Closings], own: list[tuple[list[int], tuple]]) -> np.ndarray:
    w, closings = model
    idx, row = feature_rows(own, closings)
    return 1 / (1 + np.exp(-np.bincount(row, w[idx], len(own)))) if own else np.zeros(0)


def fit_folds(made: pd.DataFrame) -> list[tuple[np.ndarray, Closings]] | None:
    """Two models, each fitted on the records of the other fold (copies of a
    text share a fold), so no record is scored by what was learnt from it. A
    first round finds the records taken for intact that look cut; the second
    does without them."""
    tails, n, gap, y, fold = made["tail"].to_numpy(), made["n"].to_numpy(), made["limit_gap"].to_numpy(), made["y"].to_numpy(float), made["fold"].to_numpy()
    own = own_rows(tails.tolist(), n, gap)
    pick = lambda at: [own[i] for i in at]
    places = [Closings.places(t) if v == 0 else None for t, v in zip(tails, y, strict=True)]
    keep = np.ones(len(made), bool)
    models: list[tuple[np.ndarray, Closings]] = []
    for _ in range(2):
        models = []
        for k in (0, 1):
            use = np.flatnonzero(keep & (fold != k))
            if len(np.unique(y[use])) < 2:
                return None
            closings = Closings.from_places([places[i] for i in use if y[i] == 0])
            models.append((fit(pick(use), y[use], closings), closings))
        for k in (0, 1):
            whole = np.flatnonzero((fold == k) & (y == 0))
            keep[whole] = score(models[k], pick(whole)) < 0.5
    return models


_BLOCK = re.compile(r"</(?:p|li|h\d|div|td|th|tr|ul|ol|table|main|section|article|blockquote|title)\s*>|<br\s*/?>|<hr\s*/?>", re.I)
_TAG = re.compile(r"<[^<>\x01]*>")
_OPEN_TAG = re.compile(r"<[^<>]*$")
_SPACE = re.compile(r"\s+")


def ends_inside(raw: bytes | None, charset: str | None, tail: str) -> bool | None:
    """The exact check: does the page go on behind the text's end within the
    same block, or does the body itself break off there? None if the end isn't
    found in the body, in any likely encoding."""
    if not raw:
        return None
    dots = _DOTS.search(tail.rstrip())
    end = _SPACE.sub("", html.unescape(_OPEN_TAG.sub("", _DOTS.sub("", tail.rstrip())).rstrip("\ufffd")))
    if len(end) < 6:
        return None
    for encoding in dict.fromkeys(("utf-8", charset or "utf-8", "cp1252", "latin-1")):
        try:
            body = raw.decode(encoding, "ignore" if encoding == "utf-8" else "strict")
        except (LookupError, UnicodeDecodeError):
            continue
        whole = "</html" in body[-200:].lower()
        blocks = [_SPACE.sub("", x) for x in html.unescape(_TAG.sub("", _OPEN_TAG.sub("", _BLOCK.sub("\x01", body)))).split("\x01")]
        plain = "".join(blocks)
        for size in (60, 24, 12):
            at = plain.rfind(end[-size:])
            if at >= 0:
                stop = at + len(end[-size:])
                if dots and plain.startswith(dots.group(1), stop):  # the page's own dots
                    stop += len(dots.group(1))
                if stop == len(plain):
                    return not whole
                return stop not in set(itertools.accumulate(map(len, blocks)))
    return None


def _fold():
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


def _uniform(*salt: str):
    return F.pmod(F.xxhash64("doc_id", "text", *map(F.lit, salt)), F.lit(1_000_003)) / 1_000_003.0


def training_records(docs: DataFrame, limits: DataFrame, sample_rows: int) -> DataFrame:
    """`tail, n, limit_gap, y` from about `sample_rows` intact records: each as
    it is (y 0), cut at a random place, and cut at its source's longest limit
    where it is longer (y 1). A cut keeps its border, or goes back to the last
    word's end, or gets an ellipsis at a limit, the remains of a tag elsewhere. Records near a limit don't count as intact."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    # Copies of a text are drawn together and then count once, so a text that makes up a third of all rows can't fill the sample.
    text = (
        docs.where(F.length("text") >= 20).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
        .where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0 < share)
        .groupBy("text").agg(F.min(F.struct("doc_id", "source")).alias("x")).select("x.*", "text")
        .withColumn("n", F.length("text")).withColumn("bytes", F.octet_length("text"))
    )
    # A limit in bytes is taken at the character where it would fall if all were of equal width.
    top = limits.groupBy("source").agg(F.max(F.when(F.col("measure") == "chars", F.col("limit"))).alias("cl"), F.max(F.when(F.col("measure") == "bytes", F.col("limit"))).alias("bl"), F.max("chance").alias("chance"))
    intact = (
        _with_gap(text, limits).where("limit_gap < 0").drop("limit_gap").join(broadcast_within(top, 100_000), "source", "left")
        .withColumn("limit", F.coalesce(F.col("cl"), (F.col("bl") * F.col("n") / F.col("bytes")).cast("int")))
    )
    u = lambda s: _uniform(s)

    def closing(t):
        return F.right(t, F.lit(TAIL))

    def record(tail, n, gap, y):
        return F.struct(tail.alias("tail"), n.cast("int").alias("n"), gap.cast("int").alias("limit_gap"), F.lit(y).alias("y"))

    # By chance an intact text is as long as a limit; as often as the counts around limits say.
    chance = F.when(u("chance") < F.col("chance") * 0.2, F.floor(u("gap") * (SLACK + 1))).otherwise(F.lit(-1))
    as_is = record(closing(F.col("text")), F.col("n"), chance, 0)

    def cut(at, style, gap_known: bool):
        body = F.substring("text", F.greatest(at - TAIL, F.lit(0)) + 1, F.least(at, F.lit(TAIL)))
        word = F.regexp_replace(body, r"\s+\S{0,7}$", "")
        added = ELLIPSES if gap_known else REMAINS
        dots = F.element_at(F.array(*map(F.lit, added)), (F.floor(u(style + "d") * 4) + 1).cast("int"))
        s = u(style)
        tail = F.when(s < 0.45, body).when(s < 0.75, F.rtrim(body)).when(s < 0.85, word).otherwise(F.concat(F.rtrim(body), dots))
        gap = F.when(s < 0.85, F.least(F.length(body) - F.length(tail), F.lit(SLACK))).otherwise(F.lit(0)) if gap_known else F.lit(-1)
        # Only a cut inside running text is a positive: the line that is cut goes on and ends like a sentence.
        rest = F.rtrim(F.substring_index(F.substring("text", at + 1, F.lit(LINE)), "\n", 1))
        return F.when((at < F.col("n")) & rest.rlike(f"[{ENDS}][{QUOTES}]*$"), record(tail, at, gap, 1))

    somewhere = (F.col("n") * (0.1 + 0.85 * u("p1"))).cast("int")
    made = F.explode(F.array_compact(F.array(as_is, cut(somewhere, "s1", False), cut(F.col("limit").cast("int"), "s3", True))))
    return intact.select(made.alias("x"), _fold().alias("fold")).select("x.*", "fold").where(F.length(F.trim("tail")) > 0)


def scored_records(docs: DataFrame, sample_rows: int = 12_000) -> DataFrame:
    """`doc_id, source, h, score` of every record by the classifier alone: `h`
    is a hash of the text. Only the last TAIL characters and the lengths reach Python."""
    limits = written(length_limits(docs), "length-limits")  # a few rows a limit, asked for several times
    made = training_records(docs, limits, sample_rows).toPandas()
    # In an order of its own, so the models don't depend on how tasks ran.
    models = fit_folds(made.sort_values(["tail", "n", "limit_gap", "y"], kind="stable", ignore_index=True))
    # Arrays only: what is broadcast must load where this package isn't installed.
    shared = docs.sparkSession.sparkContext.broadcast([(w, c.words, c.signs) for w, c in models] if models else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = [(w, Closings.of(words, signs)) for w, words, signs in shared.value or ()]
        for b in batches:
            s = np.zeros(len(b))
            for k, model in enumerate(fitted):
                at = np.flatnonzero((b["n"] > 0) & (b["fold"] == k))
                s[at] = score(model, own_rows(b["tail"].iloc[at].tolist(), b["n"].to_numpy()[at], b["limit_gap"].to_numpy()[at]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "h": b["h"], "score": s})

    rows = docs.select(
        "doc_id", F.col("source").alias("given"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("h"), F.coalesce(F.right("text", F.lit(TAIL)), F.lit("")).alias("tail"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), _fold().alias("fold"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_gap(rows, limits).select("doc_id", F.col("given").alias("source"), "h", "tail", "n", "limit_gap", "fold").mapInPandas(run, f"doc_id {kind}, source string, h long, score double")


def body_verdicts(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """`doc_id, h, inside` for the flagged records (`doc_id, h`), by `ends_inside`;
    null where the body can't tell. Bodies of other records don't reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ends_inside(raw, charset, tail) for raw, charset, tail in zip(b["raw"], b["declared_charset"], b["tail"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "inside": pd.Series(found, index=b.index, dtype="boolean")})

    wanted = broadcast_within(flagged.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), 2_000_000)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.right("text", F.lit(TAIL)).alias("tail"), "raw", "declared_charset")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
        .mapInPandas(run, f"doc_id {kind}, h long, inside boolean").groupBy("doc_id", "h").agg(F.bool_or("inside").alias("inside"))
    )


def truncated(docs: DataFrame, sample_rows: int = 12_000, threshold: float = 0.8, check_body: bool = True) -> DataFrame:
    """`doc_id, source, score, truncated` of every record.

    Truncated are the records that score above `threshold`. Cut records are far
    rarer than in training, so the threshold lies above a half. With
    `check_body` an exact check follows: a flagged record whose body shows that
    nothing of its block is missing is taken back (`ends_inside`).

    Null and empty texts are never truncated (score 0); a null source is a
    source of its own; null ids and repeated rows come out as they came in;
    other columns are ignored. The classifiers are fitted on the driver on records
    made from about `sample_rows` different texts (a bound on memory, not on what is
    scored); limits are counted over all records. Without any intact record to
    learn from every score is 0.
    """
    scored = scored_records(docs, sample_rows)
    hit = F.col("score") > threshold
    if not check_body:
        return scored.select("doc_id", "source", "score", hit.alias("truncated"))
    scored = written(scored, "scored-records")
    verdicts = body_verdicts(docs, scored.where(hit)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "inside")
    x = scored.join(broadcast_within(verdicts, 2_000_000, scored.where(hit)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return x.select("doc_id", "source", "score", (hit & F.coalesce("inside", F.lit(True))).alias("truncated"))


def source_rates(scored: DataFrame) -> DataFrame:
    """`source, n_docs, n_truncated, rate`: how often each source truncates."""
    n = F.sum(F.col("truncated").cast("long"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), n.alias("n_truncated"), F.round(n / F.count(F.lit(1)), 6).alias("rate"))
