"""Personal data: spans found by weak supervision, with DataFrame and SQL functions only.

Strict patterns with their checks give the base spans, which always count. Looser patterns give
further candidates. Four labelers vote on each candidate (yes, no, abstain): the pattern, a check
of its digits or names, a gazetteer of fixed values, and cue words before it. The counts of vote
patterns, at most 81 a kind, go to the driver, where expectation-maximisation estimates how
reliable each labeler is, and a logistic span classifier is trained on the resulting
probabilities. Its weights become a column expression that decides on every candidate.

Patterns are written so that the regex engine neither recurses nor scans a run twice, so texts and
matches may be of any length. Offsets count code points. A null text is empty and has no spans.
Repeated rows are treated each on its own. Only the named columns are read by ``spans``;
``redact`` keeps all columns and refuses tables that have columns of its working names.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base, in a form that matches the same spans without recursion: possessive
# runs, runs that begin where the last match ended or where no run is under way, and look-behind
# in place of alternation in loops.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])"
             r"(?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-]{2}))+(?<=[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20|@)"
             r"\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\.)\x20?"
             r"[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:(?:\x20{2}|[._/])[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20]|00[1-9][0-9]?[-.\x20]?[0-9]{3}[-.\x20])"
             r"[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
}
LOOSE_NEEDS = {"email": r"(?i)(?:@|at[\])}]|\x20dot\x20|dot[\])}])", "ip": r"[0-9]\x20?[\[(][.d]",
               "card": r"[0-9]{4}(?:\x20\x20|[._/])[0-9]{4}", "phone": r"[0-9]{3}[-.\x20][0-9]{4}"}
# Fixed gazetteers and cue words.
ENDINGS = ("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be "
           "test example local").split()
CUES = {
    "email": "mail e-mail email contact write reach correo courriel kontakt",
    "ip": "ip host server address addr from login dirección adresse",
    "card": "card visa credit debit account pay tarjeta carte karte konto",
    "phone": "phone call tel cell mobile fax contact teléfono téléphone telefon anruf",
}
AGAINST = "version release license licence token hash isbn doi sha order page chapter"
LABELERS = ("pattern", "check", "gazetteer", "cue")
BLOCK = 64


def _starts(found: str, gaps: str) -> list[tuple[str, str]]:
    """Columns that lead to the start of each match: running totals in blocks, so that a text
    with very many matches costs no square of their number."""
    return [
        ("_steps", f"CASE WHEN size({found}) = 0 THEN array(0) ELSE transform(sequence(0, size({found}) - 1), "
                   f"i -> length({gaps}[i]) + CASE WHEN i > 0 THEN length({found}[i - 1]) ELSE 0 END) END"),
        ("_sums", f"transform(sequence(0, CAST((size(_steps) - 1) div {BLOCK} AS INT)), "
                  f"b -> aggregate(slice(_steps, b * {BLOCK} + 1, {BLOCK}), 0, (t, x) -> t + x))"),
        ("_before", "transform(sequence(0, size(_sums) - 1), "
                    "b -> aggregate(slice(_sums, 1, b), 0, (t, x) -> t + x))"),
    ]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(df: DataFrame, out: str, pattern: str, needs: str) -> DataFrame:
    """Adds ``out``: start, end and text of every match of the pattern in ``_text``."""
    none = "CAST(array() AS array<string>)"
    df = df.withColumn("_found", F.expr(
        f"CASE WHEN rlike(_text, {_quoted(needs)}) "
        f"THEN regexp_extract_all(_text, {_quoted(pattern)}, 0) ELSE {none} END"))
    df = df.withColumn("_gaps", F.expr(
        f"CASE WHEN size(_found) > 0 THEN split(_text, {_quoted(pattern)}, -1) ELSE {none} END"))
    for name, expression in _starts("_found", "_gaps"):
        df = df.withColumn(name, F.expr(expression))
    span = (f"transform(_found, (m, i) -> named_struct('start', _before[CAST(i div {BLOCK} AS INT)] + "
            f"aggregate(slice(_steps, CAST(i div {BLOCK} AS INT) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (t, x) -> t + x), 'text', m))")
    df = df.withColumn(out, F.expr(span))
    return df.withColumn(out, F.expr(
        f"transform({out}, s -> named_struct('start', s.start, 'end', s.start + length(s.text), 'text', s.text))"
    )).drop("_found", "_gaps", "_steps", "_sums", "_before")


DIGITS = "regexp_replace(s.text, '[^0-9]', '')"
LUHN = ("aggregate(transform(sequence(1, length({d})), i -> CASE WHEN i % 2 = 1 "
        "THEN CAST(substr({d}, -i, 1) AS INT) "
        "ELSE CAST((CAST(substr({d}, -i, 1) AS INT) * 2) div 10 AS INT) "
        "+ (CAST(substr({d}, -i, 1) AS INT) * 2) % 10 END), "
        "0, (t, x) -> t + x) % 10 = 0").replace("{d}", DIGITS)
PARTS = ("forall(split(regexp_replace(s.text, '[^0-9]+', '.'), '[.]'), p -> "
         "length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS INT), 0) <= 255)")
HOLDS = {
    "email": "true",
    "ip": PARTS,
    "card": f"CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 THEN {LUHN} ELSE false END",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}


def _votes(kind: str, base: bool) -> str:
    """SQL for the four votes on span ``s`` as text, one of y, n, a each."""
    words = "|".join(CUES[kind].split())
    lead = "lower(substr(_text, greatest(1, s.start - 39), least(40, s.start)))"
    check = {
        "email": f"CASE WHEN rlike(lower(s.text), '[.\\\\x20\\\\])}}](?:{'|'.join(ENDINGS)})$') THEN 'y' ELSE 'n' END",
        "ip": f"CASE WHEN {PARTS} THEN 'y' ELSE 'n' END",
        "card": f"CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN} THEN 'y' ELSE 'n' END",
        "phone": f"CASE WHEN length({DIGITS}) BETWEEN 10 AND 15 THEN 'y' ELSE 'n' END",
    }[kind]
    known = {
        "email": "CASE WHEN rlike(s.text, '(?i)(?:@|[\\\\[({]at[\\\\])}])') THEN 'y' ELSE 'n' END",
        "ip": "CASE WHEN rlike(s.text, '^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[^0-9]') THEN 'y' ELSE 'n' END",
        "card": f"CASE WHEN rlike({DIGITS}, '^[3456]') THEN 'y' ELSE 'n' END",
        "phone": f"CASE WHEN rlike({DIGITS}, '^(?:[2-9][0-9]{{9}}|00|1|[2-9])') THEN 'y' ELSE 'a' END",
    }[kind]
    cue = (f"CASE WHEN rlike({lead}, '(?:{'|'.join(AGAINST.split())})[^a-z]*$') THEN 'n' "
           f"WHEN rlike({lead}, '(?:{words})') THEN 'y' ELSE 'a' END")
    return f"concat('{'y' if base else 'n'}', {check}, {known}, {cue})"


def candidates(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, base spans, and further candidates with their votes.

    base and more: arrays of (order of the kind, start, end, kind, votes).
    """
    out = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base, more = [], []
    for order, kind in enumerate(KINDS):
        out = _matches(out, f"_b{order}", BASE[kind], NEEDS[kind])
        out = _matches(out, f"_l{order}", LOOSE[kind], LOOSE_NEEDS[kind])
        out = out.withColumn(f"_b{order}", F.expr(f"filter(_b{order}, s -> {HOLDS[kind]})"))
        made = ("transform({a}, s -> named_struct('order', {o}, 'start', s.start, 'end', s.end, "
                "'kind', '{k}', 'votes', {v}))")
        out = out.withColumn(f"_l{order}", F.expr(
            f"filter(_l{order}, s -> NOT exists(_b{order}, b -> b.start < s.end AND s.start < b.end))"))
        base.append(made.format(a=f"_b{order}", o=order, k=kind, v=_votes(kind, True)))
        more.append(made.format(a=f"_l{order}", o=order, k=kind, v=_votes(kind, False)))
    return out.select(*keep, F.expr(f"concat({', '.join(base)})").alias("_base"),
                      F.expr(f"concat({', '.join(more)})").alias("_more"))


@dataclass
class Classifier:
    """Reliabilities by kind and labeler, and the weights of the span classifier."""

    reliability: dict[tuple[str, str], tuple[float, float]]
    bias: float
    weight: dict[tuple[int, str], float]

    def probability(self, votes: str) -> float:
        total = self.bias + sum(self.weight[i, v] for i, v in enumerate(votes))
        return 1 / (1 + math.exp(-total))

    def accepts(self, votes: Column) -> Column:
        """Whether the classifier's probability is at least one half."""
        total = F.lit(self.bias)
        for i in range(len(LABELERS)):
            vote = F.substring(votes, i + 1, 1)
            total = total + F.when(vote == "y", self.weight[i, "y"]).when(
                vote == "n", self.weight[i, "n"]).otherwise(self.weight[i, "a"])
        return total >= 0


def estimate(counts: dict[tuple[str, str], int], rounds: int = 50, prior: float = 5.0) -> Classifier:
    """EM over the counts of (kind, votes), then a logistic fit to the probabilities it gives.

    ``prior`` votes a labeler and class stand for a labeler that is right four times in five.
    """
    patterns = ["".join(p) for p in itertools.product("yna", repeat=len(LABELERS))]
    reliability, soft = {}, {}
    for kind in KINDS:
        mine = {votes: counts.get((kind, votes), 0) for votes in patterns}
        yes = [0.8] * len(LABELERS)  # chance of yes, if it votes, on a true span
        wrong = [0.2] * len(LABELERS)  # and on another
        share = 0.5

        def belief(votes: str) -> float:
            true, other = share, 1 - share
            for i, vote in enumerate(votes):
                if vote != "a":
                    true *= yes[i] if vote == "y" else 1 - yes[i]
                    other *= wrong[i] if vote == "y" else 1 - wrong[i]
            return true / (true + other)

        for _ in range(rounds):
            held = {votes: belief(votes) for votes in patterns}
            total = sum(mine.values())
            share = (prior + sum(n * held[v] for v, n in mine.items())) / (2 * prior + total)
            for i in range(len(LABELERS)):
                voted = [(v, n) for v, n in mine.items() if v[i] != "a"]
                true = sum(n * held[v] for v, n in voted)
                other = sum(n * (1 - held[v]) for v, n in voted)
                yes[i] = (0.8 * prior + sum(n * held[v] for v, n in voted if v[i] == "y")) / (prior + true)
                wrong[i] = (0.2 * prior + sum(n * (1 - held[v]) for v, n in voted if v[i] == "y")) / (prior + other)
        for i, name in enumerate(LABELERS):
            reliability[kind, name] = (yes[i], 1 - wrong[i])
        for votes in patterns:
            n, p = soft.get(votes, (0.0, 0.0))
            # Every pattern counts a little, so patterns not seen yet get sensible weights.
            weight = math.log1p(mine[votes]) + 0.1
            soft[votes] = (n + weight, p + weight * belief(votes))
    bias, weight = 0.0, {(i, v): 0.0 for i in range(len(LABELERS)) for v in "yna"}
    all_ = sum(n for n, _ in soft.values())
    for _ in range(2000):
        step = dict.fromkeys(weight, 0.0)
        tilt = 0.0
        for votes, (n, p) in soft.items():
            total = bias + sum(weight[i, v] for i, v in enumerate(votes))
            error = p - n / (1 + math.exp(-total))
            tilt += error
            for i, v in enumerate(votes):
                step[i, v] += error
        bias += 2 * tilt / all_
        for name in weight:
            weight[name] += 2 * step[name] / all_ - 0.0005 * weight[name]
    return Classifier(reliability, bias, weight)


def detect(df: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, Classifier]:
    """The ``keep`` columns with _base and _spans: base spans, and all accepted ones in order."""
    rows = written(candidates(df, text, keep), "spans")
    voted = rows.select(F.explode(F.concat("_base", "_more")).alias("s")).select("s.kind", "s.votes")
    counts = {(r.kind, r.votes): r["count"] for r in voted.groupBy("kind", "votes").count().collect()}
    model = estimate(counts)
    chosen = F.array_sort(F.concat("_base", F.filter("_more", lambda s: model.accepts(s["votes"]))))
    return rows.select(*keep, "_base", chosen.alias("_spans")), model


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, counts of base spans by kind, the base spans and all spans as kind:start:end."""
    rows, _ = detect(df, text, [key])
    counts = [F.expr(f"CAST(size(filter(_base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
              for k in KINDS]
    return rows.select(key, *counts, _listed("_base").alias("base"), _listed("_spans").alias("spans"))


def redact(df: DataFrame, text: str) -> DataFrame:
    """All columns, with every span of the text replaced by its kind in brackets.

    Spans that overlap become one and take the kind of the first. A text without spans stays.
    """
    working = {"_text", "_base", "_more", "_spans", "_cover"} & set(df.columns)
    if working:
        raise ValueError(f"columns {sorted(working)} are used here")
    rows, _ = detect(df, text, df.columns)
    by_start = F.array_sort(F.expr(
        "transform(_spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))"))
    rows = rows.withColumn("_cover", by_start).withColumn("_cover", F.expr("""
        aggregate(_cover, CAST(array() AS array<struct<start:int,end:int,kind:string>>), (done, s) ->
          CASE WHEN size(done) > 0 AND s.start < done[size(done) - 1].end
          THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
            'start', done[size(done) - 1].start, 'end', greatest(done[size(done) - 1].end, s.end),
            'kind', done[size(done) - 1].kind)))
          ELSE concat(done, array(s)) END)"""))
    clean = F.expr(f"""
        CASE WHEN size(_cover) = 0 THEN `{text}` ELSE concat(
          array_join(transform(_cover, (s, i) -> concat(
            substr(`{text}`, CASE WHEN i = 0 THEN 0 ELSE _cover[i - 1].end END + 1,
                   s.start - CASE WHEN i = 0 THEN 0 ELSE _cover[i - 1].end END),
            '[', upper(s.kind), ']')), ''),
          substr(`{text}`, _cover[size(_cover) - 1].end + 1)) END""")
    return rows.withColumn(text, clean).select(*df.columns)
