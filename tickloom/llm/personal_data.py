"""Personal data by weak supervision, in SQL functions alone.

Regular expressions find sure (base) spans and further candidates.  Labelers (expressions, gazetteers, context) vote on
each; expectation-maximisation over the counts of their vote patterns estimates how reliable each labeler is, and its
posteriors train a span classifier on the counts of feature patterns.  Both tables of counts are bounded by the number of
patterns, whatever the number of documents, so they are what the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.registry import query, table
from tickloom.llm.shared import saved

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "handle")
_LOCAL = "[A-Za-z0-9._%+-]"
# The contract's expressions, written so that Java's matcher neither recurses nor retries inside a run: possessive
# repeats, and a start only where a run begins or the match before ended (\G).
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "number": r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()-]{0,2}[0-9]){6,}+",
    "handle": r"(?<![A-Za-z0-9@._%+-])@[A-Za-z0-9_]{3,}+",
}
# What a text must hold before the expression is tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
         "secret": "[A-Za-z0-9_-]{20}", "number": r"[0-9](?:[\x20()-]{0,2}[0-9]){6}", "handle": "@"}
SPAN = "array<struct<kind: int, start: int, end: int>>"

SECRET_WORDS = "token|secret|api.?key|access.?key|password|passwd|passwort|kennwort|contraseña|clave|mot de passe|bearer"
CONTACT_WORDS = "phone|fon|tel|mobile|handy|fax|call|card|karte|tarjeta|carte|visa|iban|konto|account|cuenta|compte|ssn"
PUBLIC_WORDS = "version|isbn|issn|doi|page|seite|página|chapter|copyright|licen|rfc|©|https?:|www|commit|sha"
# Gazetteers: what a span itself is looked up in.
GIVEN_NAMES = ("anna anne ben carla carlos chloe claire daniel david diego elena emily emma eric felix hans ines jack james jan john jose "
               "juan julia karl laura lena leo linda lisa lucas lucia maria marie mark martin mary max mia michael nina noah olivia "
               "oscar otto paul paula pedro peter petra pierre rosa sam sara sofia sophie thomas tim tom").split()
MAIL_HOSTS = ("gmail.com googlemail.com yahoo.com outlook.com hotmail.com live.com icloud.com aol.com gmx.de gmx.net web.de "
              "orange.fr laposte.net libero.it proton.me protonmail.com").split()
PUBLIC_HANDLES = ("media import charset supports keyframes layer param return returns throws throw see since author version override "
                  "deprecated suppresswarnings test before after everyone here channel todo property staticmethod classmethod").split()
PUBLIC_NUMBERS = ("1234567 12345678 123456789 1234567890 0123456789 4111111111111111 4242424242424242 5555555555554444 "
                  "378282246310005 3141592 31415926 2718281 2147483647 2147483648 4294967295 4294967296").split()
LABELERS = 9
BEFORE = 24  # characters before a span that labelers look at


def _octet() -> str:
    return "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the right, every second one doubled, sum to a multiple of ten."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^(?:{_octet()}\.){{3}}{_octet()}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _powers(size: Column) -> Column:
    """1, 2, 4 .. below ``size``; empty for a size of 0 or 1."""
    bits = F.when(size > 1, F.sequence(F.lit(0), F.length(F.bin(size - 1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(bits, lambda k: F.pow(F.lit(2), k).cast("int"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array, by doubling steps: n log n work, where a fold copies its result n times."""
    return _let(values, lambda first: F.aggregate(
        _powers(F.size(first)), first, lambda acc, step: F.transform(
            acc, lambda x, i: F.when(i >= step, combine(F.get(acc, i - step), x)).otherwise(x))))


def matches(text: Column, kind: str) -> Column:
    """(kind, start, end, found) of the valid matches of a kind, in code points.

    The pieces between the matches and the matches themselves add up to the places.
    """
    pattern = F.lit(PATTERNS[kind])
    pairs = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda piece, found: F.struct(F.length(piece).alias("skip"), F.length(found).alias("size"), found.alias("found")))

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: x["skip"] + F.coalesce(x["size"], F.lit(0))), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda x, end: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (end - x["size"]).alias("start"), end.alias("end"), x["found"].alias("found")))

    spans = F.filter(_let(pairs, placed), lambda s: s["found"].isNotNull() & _valid(kind, s["found"]))
    none = F.array().cast("array<struct<kind: int, start: int, end: int, found: string>>")
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)


BLOCK = 512  # code points


def blocks(text: Column) -> Column:
    """The text in blocks, so that a piece of it is cut without walking there from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from place ``start`` (from 0) on."""
    first = F.floor(start / BLOCK).cast("int")
    part = F.slice(blocks, first + 1, F.floor((start + length) / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(part, ""), start - first * BLOCK + 1, length)


def _votes(span: Column, before: Column, after: Column, in_doc: Column) -> list[Column]:
    """One vote per labeler: 2 for personal data, 0 against, 1 for none."""
    found, kind = span["found"], span["kind"]
    low, digits = F.lower(before), F.regexp_replace(span["found"], "[^0-9]", "")

    def yes(condition: Column, no: Column | None = None) -> Column:
        out = F.when(condition, 2)
        return (out.when(no, 0) if no is not None else out).otherwise(1)

    email, secret, number, handle = (kind == KINDS.index(k) for k in ("email", "secret", "number", "handle"))
    base = kind < len(BASE)
    return [
        yes(base),  # an expression with a check behind it
        yes(found.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), secret & ~found.rlike("[0-9]")),
        yes(number & found.rlike(r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|"
                                 r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4})$"),
            number & found.rlike(r"^(?:[0-9]{1,4}[ -]){0,2}[0-9]{1,4}$")),
        yes(low.rlike(rf"(?:{SECRET_WORDS})\W*$"), low.rlike(rf"(?:{PUBLIC_WORDS})\W*$")),
        yes(low.rlike(rf"\b(?:{CONTACT_WORDS})\b")),
        yes(before.rlike("[=:]\\s*[\"']?$"), before.rlike("[A-Za-z][-_/]$")),
        yes(in_doc),
        yes((secret & found.rlike("[0-9]") & found.rlike("[A-Za-z]")) | (number & (F.length(digits) >= 13)),
            (secret & ~found.rlike("[0-9]")) | (number & digits.rlike(r"^([0-9])\1+$"))),
        yes((email & F.lower(F.substring_index(found, "@", -1)).isin(MAIL_HOSTS))
            | (handle & F.regexp_extract(F.lower(found), "^@([a-z]+)", 1).isin(GIVEN_NAMES)),
            (handle & F.lower(F.substring(found, 2, 64)).isin(PUBLIC_HANDLES)) | (number & digits.isin(PUBLIC_NUMBERS))),
    ]


FEATURES = (len(KINDS), 16, 5, 2, 5, 2)  # values of each feature


def _features(span: Column, before: Column, after: Column) -> list[Column]:
    found, size = span["found"], F.length(span["found"])
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    sign = F.right(before, F.lit(1))
    return [
        span["kind"], F.least(F.floor(size / 4).cast("int"), F.lit(15)), F.floor(digits * 4 / size).cast("int"),
        found.rlike("[ -]").cast("int"),
        F.when((sign == "") | sign.rlike(r"\s"), 0).when(sign.isin('"', "'"), 1).when(sign.isin("=", ":"), 2)
        .when(sign == "(", 3).otherwise(4),
        F.lower(before).rlike(rf"(?:{SECRET_WORDS}|{CONTACT_WORDS})\W*$").cast("int"),
    ]


def _code(values: list[Column], bases: tuple[int, ...]) -> Column:
    out, unit = F.lit(0), 1
    for value, base in zip(values, bases):
        out, unit = out + value * unit, unit * base
    return out


def _cover(spans: Column) -> Column:
    """Spans by their starts, each with the furthest end up to it."""
    places = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return running(places, lambda a, b: F.struct(b["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end")))


def _overlaps(cover: Column, span: Column) -> Column:
    """Whether a span meets one of those covered: a binary search for the last that starts before its end."""
    steps = F.reverse(_powers(F.size(cover) + 1))
    before = F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.coalesce(F.get(cover, low + step - 1)["start"] < span["end"], F.lit(False)), low + step).otherwise(low))
    return _let(before, lambda n: F.coalesce(F.get(cover, n - 1)["end"] > span["start"], F.lit(False)))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base``, the base spans, and ``_more``, all spans with the codes of their votes and features."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_body", body)
    for kind in KINDS:
        docs = docs.withColumn(f"_{kind}", matches(F.col("_body"), kind))
    docs = docs.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in BASE]))
    none = F.array().cast(docs.schema["_base"].dataType)

    def outside(kind: str, taken: Column) -> Column:
        spans = F.col(f"_{kind}")
        return F.when(F.size(spans) == 0, none).when(F.size(taken) == 0, spans).otherwise(
            _let(_cover(taken), lambda c: F.filter(spans, lambda s: ~_overlaps(c, s))))

    docs = docs.withColumn("_extra", outside("secret", F.col("_base")))
    for kind in ("number", "handle"):
        docs = docs.withColumn("_extra", F.concat("_extra", outside(kind, F.concat("_base", "_extra"))))

    def seen(parts: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] - BEFORE, F.lit(0))
        return F.struct(s.alias("span"), cut(parts, begin, s["start"] - begin).alias("before"), cut(parts, s["end"], F.lit(2)).alias("after"))

    def coded(x: Column) -> Column:
        s, before, after = x["span"], x["before"], x["after"]
        votes = _votes(s, before, after, F.size("_base") > 0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        _code(votes, (3,) * LABELERS).alias("votes"),
                        _code(_features(s, before, after), FEATURES).alias("features"))

    spans = F.concat("_base", "_extra")
    more = _let(blocks(F.col("_body")), lambda parts: F.transform(F.transform(spans, lambda s: seen(parts, s)), coded))
    empty = F.array().cast("array<struct<kind: int, start: int, end: int, votes: int, features: int>>")
    return (docs.withColumn("_more", F.when(F.size(spans) > 0, more).otherwise(empty))
            .withColumn("_base", F.transform("_base", _span))
            .drop("_body", "_extra", *[f"_{k}" for k in KINDS]))


def _span(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


@dataclass
class Model:
    prior: float
    reliability: np.ndarray  # labeler x class x vote: probability of the vote
    weights: list[list[float]]  # per feature, per value
    bias: float


def _digits(codes: np.ndarray, bases: tuple[int, ...]) -> np.ndarray:
    out = []
    for base in bases:
        out.append(codes % base)
        codes = codes // base
    return np.stack(out, axis=1) if len(out) else np.zeros((len(codes), 0), int)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: prior, reliabilities and the posterior of each pattern.

    Begins with every labeler somewhat better than chance, which settles which class is which; one count of smoothing keeps
    votes never seen possible.
    """
    start = np.array([[0.4, 0.4, 0.2], [0.1, 0.4, 0.5]])
    table_ = np.repeat(start[None], votes.shape[1], axis=0)
    prior, post = 0.5, np.full(len(votes), 0.5)
    for _ in range(rounds):
        logs = np.log(table_)
        each = np.array([np.log([1 - prior, prior])] * len(votes)).reshape(-1, 2)
        for j in range(votes.shape[1]):
            each += logs[j][:, votes[:, j]].T
        post = 1 / (1 + np.exp(np.clip(each[:, 0] - each[:, 1], -50, 50)))
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        for j in range(votes.shape[1]):
            for c in (0, 1):
                seen = np.bincount(votes[:, j], weight[c], 3) + 3 * start[c]
                table_[j, c] = seen / seen.sum()
    return prior, table_, post


def train(patterns: list[tuple[int, int, int]]) -> Model:
    """Fit on (votes code, features code, count) rows."""
    votes = _digits(np.array([p[0] for p in patterns], int), (3,) * LABELERS)
    values = _digits(np.array([p[1] for p in patterns], int), FEATURES)
    counts = np.array([p[2] for p in patterns], float)
    prior, table_, post = estimate(votes, counts)
    weights, bias = [np.zeros(n) for n in FEATURES], 0.0
    total = max(counts.sum(), 1.0)
    for _ in range(400):
        odds = bias + sum(w[values[:, i]] for i, w in enumerate(weights))
        error = counts * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - post) / total
        bias -= 2.0 * error.sum()
        for i, w in enumerate(weights):
            w -= 2.0 * (np.bincount(values[:, i], error, len(w)) + 1e-4 * w)
    return Model(prior, table_, [w.tolist() for w in weights], float(bias))


def learn(candidates: DataFrame) -> Model:
    """Model from the candidates of all documents; only counts of patterns leave the executors."""
    rows = (candidates.select(F.explode("_more").alias("s")).groupBy("s.votes", "s.features")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("votes", "features").collect())
    return train([tuple(r) for r in rows])


def accepted(model: Model, threshold: float = 0.5) -> Column:
    """All spans: the base ones, and the candidates that the classifier accepts; by kind, then place."""
    odds_at = float(np.log(threshold / (1 - threshold)))

    def likely(s: Column) -> Column:
        total, unit = F.lit(model.bias), 1
        for base, weights in zip(FEATURES, model.weights):
            value = F.floor(s["features"] / unit).cast("int") % base
            total, unit = total + F.get(F.array(*map(F.lit, weights)), value), unit * base
        return (s["kind"] >= len(BASE)) & (total >= odds_at)

    return F.sort_array(F.concat("_base", F.transform(F.filter("_more", likely), _span)))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    Base spans follow the contract's expressions and checks and always stay; the classifier adds spans of the kinds
    secret, number and handle, which never overlap a base span.  Places are code points, ends exclusive.

    Null and empty texts have no spans; repeated rows each keep a row; a text of any length and with any number of matches is
    searched whole: no expression retries inside a run, and places, overlaps and contexts cost n log n; without any candidate the model accepts none; an empty table gives an
    empty result; other columns are not returned.
    """
    found = saved(with_candidates(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
                  .select("doc_id", "_base", "_more"), "spans")
    model = learn(found)
    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(as_text(F.sort_array("_base")), 256).alias("base_sha256"),
                        as_text(accepted(model)).alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as ``<EMAIL>``; all columns stay.

    Overlapping spans are masked together under the kind of the first.  A null text stays null.  No other column
    takes part, whatever its name.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    others = [c for c in docs.columns if c != text]
    whole = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_row")
    # Rows are written with their candidates, so that no text is searched twice.
    rows = saved(with_candidates(docs.select(whole, F.col(f"`{text}`").alias("text"))).select("_row", "text", "_base", "_more"), "spans")
    rows = rows.withColumn("_all", accepted(learn(rows)))
    by_place = F.array_sort(F.transform("_all", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(parts: Column, spans: Column, reach: Column, i: Column) -> Column:
        """What lies between the furthest end before a span and the span, and its kind; nothing for one that overlaps."""
        at = F.coalesce(F.get(reach, i - 1), F.lit(0))
        s = F.get(spans, i)
        return F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"] - at), F.get(names, s["kind"]))).otherwise("")

    def joined(parts: Column, spans: Column, reach: Column) -> Column:
        at = F.array_max(reach)
        return F.concat(F.array_join(F.transform(spans, lambda s, i: piece(parts, spans, reach, i)), ""),
                        cut(parts, at, F.char_length("text") - at))

    done = _let(blocks(F.col("text")), lambda parts: _let(by_place, lambda spans: _let(
        running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda reach: joined(parts, spans, reach))))
    rows = rows.withColumn("_clean", F.when(F.size("_all") > 0, done).otherwise(F.col("text")))
    return rows.select(*[(F.col("_clean") if c == text else F.col(f"_row.c{others.index(c)}")).alias(c) for c in docs.columns])


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
