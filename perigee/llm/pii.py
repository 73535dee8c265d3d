"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base kinds (email, ip, card, phone) are patterns with checks and always stay. High-recall generators
propose further, overlapping candidates; each is described by a 17-bit code of its format and context, without the
signs that the base patterns ask for (a plus, a dot in the domain). Over the whole corpus the codes are counted by kind of
candidate: positive, as it meets a checked base span; negative, as nothing introduces it and it can't be what its generator
looks for (too few or too many digits, a wrong check digit, letters on either side, no domain, not four parts). All others are
open: the trees haven't seen them and decide them. The counts are a table of at most 2**18 rows, whatever the corpus,
on which the driver fits boosted trees. One half of the documents (by hash) trains them, the other calibrates for each
generator the threshold that reaches the wanted precision. Trees and thresholds go back into the plan as expressions on the code.

Positions are code points: a text is split at the matches, and what lies before a match is summed up.

Defined results: null texts count as empty, with no spans and the digest of the empty string; null identifiers and
repeated rows are kept as they are; very long texts and very long candidates are taken whole; an empty table, or one
without candidates, adds no spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import own, restored, settle, shielded

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; the guards in front only say where a leftmost match can begin (at a run's start, or right
#: after the last match), and what can't give back is possessive, so that long runs take linear time.
_BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_HINT = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]")
GENERATORS = ("handle", "number", "dotted")
#: No length is bounded; what is possessive can't be tried again, so that long runs take linear time.
_PROPOSE = (
    r"(?<![^\s@<>()\x22',;])[^\s@<>()\x22',;]++@[^\s@<>()\x22',;]++",
    r"(?<![0-9])[+(]?+[0-9]++(?:[()\x20.-]{1,3}+[0-9]++)*+",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}+",
)
_PROPOSE_HINT = ("@", r"[0-9][0-9()\x20.-]{5}", r"[0-9]\.[0-9]")
#: Digits below which a number isn't proposed.
_DIGITS = 7
_CUES = r"(?i)(phone|tel|call|mobile|fax|mail|contact|write|reach|card|visa|address|host|server|login|user|ip)[^\p{L}]*$"
#: Field: (first bit, bits).
_FIELDS = {"generator": (0, 2), "digits": (2, 3), "dots": (5, 3), "space": (8, 1), "dash": (9, 1), "bracket": (10, 1), "letters": (11, 2), "before": (13, 2), "cue": (15, 1), "after": (16, 1)}


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s: start, e: end, m: text>> in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    likely = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
    return F.when(likely, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: int, m: Column) -> Column:
    digits = _digits(m)
    if kind == 1:
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == 2:
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == 3:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> list[Column]:
    """For each base kind array<struct<s, k, e>> of the matches that pass its check."""

    def checked(kind: int) -> Column:
        good = F.filter(matches(text, _BASE[kind], _HINT[kind]), lambda x: _valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    return [checked(kind) for kind in range(len(KINDS))]


def _put(**fields: Column) -> Column:
    code = F.lit(0)
    for name, value in fields.items():
        code = code + F.shiftleft(value.cast("int"), _FIELDS[name][0])
    return code


def _impossible(g: int, m: Column, digits: Column) -> Column:
    """Whether a candidate that nothing introduces can't be what its generator looks for."""
    n = F.length(digits)
    if g == 0:
        return ~m.rlike(r"@[^.]+\.[^.]")
    if g == 1:
        checked = n.between(12, 19) & ~F.startswith(m, F.lit("+"))
        return (n < 9) | (n > 19) | (checked & ~F.call_function("luhn_check", digits))
    return (F.length(F.regexp_replace(m, r"[^.]", "")) != 3) | ~_valid(1, m)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<s, k, e, code, hit, miss>>: all proposals; ``hit``: it meets a base span, ``miss``: it can't be right."""

    def proposed(g: int) -> Column:
        def describe(x: Column) -> Column:
            m, s, e = x["m"], x["s"], x["e"]
            digits = _digits(m)
            n, letters = F.length(digits), F.length(F.regexp_replace(m, r"[^\p{L}]", ""))
            around = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))
            last = F.right(around, F.lit(1))
            cue, after = around.rlike(_CUES), F.substring(text, e + 1, F.lit(1)).rlike(r"[\p{L}0-9]")
            before = F.when(s == 0, 0).when(last.rlike(r"[\p{L}0-9]"), 2).when(last.rlike(r"\s"), 0).when(last.isin(":", "=", '"', "<", "("), 1).otherwise(3)
            code = _put(
                generator=F.lit(g),
                digits=F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n == 9, 3).when(n == 10, 4).when(n < 13, 5).when(n < 16, 6).otherwise(7),
                dots=F.least(F.length(F.regexp_replace(m, r"[^.]", "")), F.lit(7)),
                space=F.contains(m, F.lit(" ")),
                dash=F.contains(m, F.lit("-")),
                bracket=F.contains(m, F.lit("(")),
                letters=F.when(letters == 0, 0).when(letters < 4, 1).when(letters < 12, 2).otherwise(3),
                before=before,
                cue=cue,
                after=after,
            )
            hit = F.exists(base, lambda b: (b["s"] < e) & (b["e"] > s))
            miss = ~hit & ~cue & (_impossible(g, m, digits) | (before == 2) | after)
            return F.struct(s.alias("s"), F.lit(len(KINDS) + g).alias("k"), e.alias("e"), code.alias("code"), hit.alias("hit"), miss.alias("miss"))

        found = matches(text, _PROPOSE[g], _PROPOSE_HINT[g])
        return F.transform(F.filter(found, lambda x: F.length(_digits(x["m"])) >= _DIGITS) if g == 1 else found, describe)

    return F.concat(*(proposed(g) for g in range(len(GENERATORS))))


def scan(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """id, the columns in ``keep``, base and proposals of every text."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, own(text_col).alias("_text"))
    rows = rows.withColumn("_base", F.array_sort(F.concat(*base_spans(F.col("_text")))))
    return rows.withColumn("_more", candidates(F.col("_text"), F.col("_base"))).drop("_text")


@dataclass(frozen=True)
class Boosted:
    """Trees of two levels on fields of the code, (field, cut, [(field, cut, low, high)] * 2), and a threshold per generator."""

    bias: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, code: Column) -> Column:
        field = lambda name: F.shiftright(code, _FIELDS[name][0]).bitwiseAND(F.lit(2 ** _FIELDS[name][1] - 1))
        total = F.lit(self.bias)
        for name, cut, branches in self.trees:
            low, high = (F.when(field(f) <= c, a).otherwise(b) for f, c, a, b in branches)
            total = total + F.when(field(name) <= cut, low).otherwise(high)
        return total

    def accepts(self, x: Column) -> Column:
        limit = F.lit(float("inf"))
        for g, threshold in enumerate(self.thresholds):
            limit = F.when(x["k"] == len(KINDS) + g, threshold).otherwise(limit)
        return self.score(x["code"]) >= limit


def _split(table: dict[str, np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, ridge: float) -> tuple:
    """The cut of one field that gains most on ``rows``, with the two leaf values."""
    best = (-1.0, "generator", 7, 0.0, 0.0)
    for name, values in table.items():
        v = values[rows]
        g, h = np.bincount(v, grad[rows], 8), np.bincount(v, hess[rows], 8)
        gl, hl = np.cumsum(g), np.cumsum(h)
        gain = gl**2 / (hl + ridge) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + ridge)
        cut = int(np.argmax(gain))
        if gain[cut] > best[0]:
            best = (float(gain[cut]), name, cut, float(gl[cut] / (hl[cut] + ridge)), float((gl[-1] - gl[cut]) / (hl[-1] - hl[cut] + ridge)))
    return best


def boost(codes: np.ndarray, hits: np.ndarray, misses: np.ndarray, train: np.ndarray, rounds: int = 24, rate: float = 0.3, ridge: float = 1.0, precision: float = 0.95) -> Boosted:
    """Newton boosting on counts by code; ``train``: rows to fit, the others calibrate the thresholds.

    A threshold is the least score at which accepted held-out candidates are hits with ``precision``, smoothed by one miss;
    a generator that never reaches it accepts nothing.
    """
    table = {name: (codes >> at) & (2**bits - 1) for name, (at, bits) in _FIELDS.items()}
    n, pos = np.where(train, hits + misses, 0).astype(float), np.where(train, hits, 0).astype(float)
    bias = float(np.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1)))
    score, trees = np.full(len(codes), bias), []
    everything = np.arange(len(codes))
    for _ in range(rounds if n.sum() else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = pos - n * p, n * p * (1 - p)
        _, name, cut, _, _ = _split(table, grad, hess, everything, ridge)
        left = table[name] <= cut
        branches = []
        for rows in (everything[left], everything[~left]):
            _, f, c, a, b = _split(table, grad, hess, rows, ridge)
            branches.append((f, c, rate * a, rate * b))
            score[rows] += np.where(table[f][rows] <= c, rate * a, rate * b)
        trees.append((name, cut, tuple(branches)))
    thresholds = []
    for g in range(len(GENERATORS)):
        rows = np.flatnonzero((table["generator"] == g) & ~train)
        rows = rows[np.argsort(-score[rows], kind="stable")]
        good, bad = np.cumsum(hits[rows]), np.cumsum(misses[rows])
        last = np.append(np.diff(score[rows]) != 0, True) if len(rows) else np.zeros(0, bool)
        fine = np.flatnonzero(last & (good / (good + bad + 1) >= precision))
        thresholds.append(float(score[rows[fine[-1]]]) if len(fine) else float("inf"))
    return Boosted(bias, tuple(trees), tuple(thresholds))


def fit(scanned: DataFrame, by: str = "id", **options: float) -> Boosted:
    """Count the codes of all candidates and boost on the counts; ``by`` halves the documents."""
    half = F.pmod(F.xxhash64(by), F.lit(2)).alias("half")
    counts = scanned.select(half, F.explode("_more").alias("c")).groupBy("half", "c.code").agg(F.count_if("c.hit").alias("hits"), F.count_if("c.miss").alias("misses"))
    rows = np.array([tuple(r) for r in counts.toLocalIterator()], np.int64).reshape(-1, 4)  # at most 2**18
    rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
    return boost(rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 0] == 0, **options)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *GENERATORS)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def all_spans(model: Boosted) -> Column:
    """Base spans and accepted open proposals, which meet none of them, by start and kind."""
    added = F.filter("_more", lambda x: ~x["hit"] & ~x["miss"] & model.accepts(x))
    return F.array_sort(F.concat("_base", F.transform(added, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per document."""
    scanned = settle(scan(docs, id_col, text_col))
    found = scanned.withColumn("_all", all_spans(fit(scanned)))

    def count(k: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"), (F.size("_all") - F.size("_base")).cast("long").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by the kind in brackets; overlapping spans give one."""
    kinds = F.array(*(F.lit(f"[{x.upper()}]") for x in (*KINDS, *GENERATORS)))
    columns, names = shielded(docs)
    text_col = names[text_col]
    rows = docs.select(*columns).withColumn("_base", F.array_sort(F.concat(*base_spans(own(text_col)))))
    rows = settle(rows.withColumn("_more", candidates(own(text_col), F.col("_base"))))  # texts are searched once
    rows = rows.withColumn("_all", all_spans(fit(rows, names[id_col])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col(text_col), acc["at"] + 1, x["s"] - acc["at"])
        meets = x["s"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(meets, acc["out"]).otherwise(F.concat(acc["out"], kept, F.get(kinds, x["k"]))).alias("out"))

    clean = F.aggregate("_all", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.char_length(text_col))))
    return restored(rows.withColumn(text_col, F.when(F.size("_all") > 0, clean).otherwise(F.col(text_col))), names)
