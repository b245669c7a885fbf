"""Scores: normalisation, entropies, frontiers, labels and orientations derived from flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cluster codes and epistemic flags.
CLUSTERS = ("si", "ps", "sts", "law", "pa", "bcs")
FLAGS = ("epi_positivista", "epi_interpretativa", "epi_doutrinario_normativa")
#: Gates and bands of agreement.
ALPHA_GATE_CLUSTER, ALPHA_GATE_EPI, DN_FLOOR, KAPPA_REFERENCE, WEIGHT_CAP = 0.67, 0.55, 0.667, 0.61, 10.0
FIRM, TENTATIVE = 0.80, 0.667
#: How close two scores are at the frontier, and how low the best is.
DELTA, LOW_TOP = 0.15, 0.55


def normalised(raw: Sequence[Column]) -> list[Column]:
    """Scores that sum to 1; negative and missing ones count 0; all 0 gives equal shares."""
    own = [F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in raw]
    total = sum(own[1:], own[0])
    return [F.when(total <= 0, F.lit(1.0 / len(own))).otherwise(c / F.when(total > 0, total)) for c in own]


def clipped(raw: Column) -> Column:
    """In [0, 1]; what is no number counts 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))


def entropy(scores: Sequence[Column]) -> Column:
    """Shannon entropy over its largest value."""
    return -sum((s * F.log(s + F.lit(1e-12)) for s in scores), F.lit(0.0)) / F.log(F.lit(float(len(scores))))


def entropy_nats(scores: Sequence[Column]) -> Column:
    """Shannon entropy in nats of scores clipped at 1e-12 and made to sum to 1."""
    own = [F.greatest(s, F.lit(1e-12)) for s in scores]
    total = sum(own[1:], own[0])
    return -sum(((s / total) * F.log(s / total) for s in own), F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at 0 and 1."""
    inside = (p > 0) & (p < 1)
    return F.when(inside, -(p * F.log2(F.when(inside, p)) + (1 - p) * F.log2(F.when(inside, 1 - p)))).otherwise(F.lit(0.0))


def uncertainty(scores: Sequence[Column]) -> Column:
    return sum((binary_entropy(s) for s in scores), F.lit(0.0)) / len(scores)


def ordered(scores: Sequence[Column]) -> Column:
    """The scores, largest first."""
    return F.sort_array(F.array(*scores), asc=False)


def gap(scores: Sequence[Column]) -> Column:
    """Best less second best."""
    best = ordered(scores)
    return best[0] - best[1]


def at_frontier(scores: Sequence[Column]) -> Column:
    """Whether the best leads by less than DELTA (to nine digits, so that sums of decimals compare as written)."""
    return F.round(gap(scores), 9) < DELTA


def at_sampling_frontier(scores: Sequence[Column]) -> Column:
    return (gap(scores) < DELTA) | (ordered(scores)[0] < LOW_TOP)


def flags_at_frontier(scores: Sequence[Column]) -> Column:
    """Whether a flag's score is less than DELTA off one half (to nine digits)."""
    return F.exists(F.array(*scores), lambda s: F.round(F.abs(s - 0.5), 9) < DELTA)


def best_label(scores: Sequence[Column], labels: Sequence[str]) -> Column:
    """The label of the largest score, the first of equals."""
    own = F.array(*scores)
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(own, F.array_max(own)).cast("int"))


def second_label(scores: Sequence[Column], labels: Sequence[str]) -> Column:
    """The runner-up where it is within DELTA of the best, else null."""
    pairs = F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, (s, x) in enumerate(zip(scores, labels, strict=True))))
    second = F.array_sort(pairs)[1]["x"]
    return F.when(gap(scores) < DELTA, second)


def primary_label(given: Column, scores: Sequence[Column], labels: Sequence[str]) -> tuple[Column, Column]:
    """The given label if it is one of the labels, else the best; and whether it fell back."""
    valid = F.coalesce(given.isin(*labels), F.lit(False))
    return F.when(valid, given).otherwise(best_label(scores, labels)), ~valid


def flag(value: Column) -> Column:
    """0 or 1 from a number; anything else is an error."""
    own = F.round(value.cast("double")).cast("int")
    return F.when(own.isin(0, 1), own).otherwise(F.raise_error(F.concat(F.lit("a flag is 0 or 1, not "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int"))


def prominent(positivist: Column, interpretive: Column) -> Column:
    """By the first axis alone; no flag has priority."""
    return F.when((positivist == 1) & (interpretive == 1), "mixed").when(positivist == 1, "positivista").when(interpretive == 1, "interpretativa").otherwise("nenhuma")


def configuration(positivist: Column, interpretive: Column, doctrinal: Column) -> Column:
    parts = F.concat_ws("+", F.when(positivist == 1, "EE"), F.when(interpretive == 1, "IC"), F.when(doctrinal == 1, "DN"))
    return F.when(parts == "", "all_zero").otherwise(parts)


def derive(df: DataFrame, prefix: str = "epi_") -> DataFrame:
    """Adds orientacao_proeminente, configuracao and inconclusiva from the three flags."""
    ee, ic, dn = (flag(F.col(f"{prefix}{name}")) for name in ("positivista", "interpretativa", "doutrinario_normativa"))
    return df.withColumns({"orientacao_proeminente": prominent(ee, ic), "configuracao": configuration(ee, ic, dn), "inconclusiva": F.when((ee == 0) & (ic == 0) & (dn == 0), 1).otherwise(0)})


def softmax(logits: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logits)
    own = [F.exp(x - top) for x in logits]
    total = sum(own[1:], own[0])
    return [x / total for x in own]


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def flag_certainty(probabilities: Sequence[Column]) -> Column:
    return sum((2 * F.abs(p - 0.5) for p in probabilities), F.lit(0.0)) / len(probabilities)


def agreement_band(alpha: Column) -> Column:
    return F.when(alpha.isNull() | F.isnan(alpha), "indefinido").when(alpha >= FIRM, "firme").when(alpha >= TENTATIVE, "tentativo").otherwise("insuficiente")


def doctrine_tag(notes: Column) -> Column:
    """The dn: tag named in notes: ambos before modo before norm."""
    own = F.lower(F.coalesce(notes, F.lit("")))
    return F.when(own.contains("dn:ambos"), "ambos").when(own.contains("dn:modo"), "modo").when(own.contains("dn:norm"), "norm")


def stratum(*parts: Column) -> Column:
    """Parts joined by |, a missing one as NA."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("NA")) for p in parts))


def violations(positivist: Column, interpretive: Column, doctrinal: Column, confidence: Column, notes: Column) -> Column:
    """The rules that an annotation row breaks, as a list of codes; bad numbers end the check at once."""
    flags = [F.round(c.try_cast("double")).cast("int") for c in (positivist, interpretive, doctrinal)]
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(f.isin(0, 1), F.lit(False)), F.lit(f"flag {n}")) for n, f in zip(("EE", "IC", "DN"), flags, strict=True))))
    level = F.round(confidence.try_cast("double")).cast("int")
    note = F.trim(F.coalesce(notes, F.lit("")))
    note = F.when(F.lower(note).isin("nan", "none"), F.lit("")).otherwise(note)
    names = F.upper(note).rlike("EE|IC|DN")
    rules = F.array_compact(
        F.array(
            F.when(~level.isin(1, 2, 3), F.lit("confidence range")),
            F.when((level <= 1) & (note == ""), F.lit("low confidence without notes")),
            F.when((level <= 1) & (note != "") & ~names, F.lit("low confidence without a named mark")),
            F.when((flags[2] == 1) & doctrine_tag(note).isNull(), F.lit("doctrine without a tag")),
            F.when((flags[0] == 0) & (flags[1] == 0) & (flags[2] == 0) & (level > 1), F.lit("all zero with confidence")),
        )
    )
    return F.when(F.size(bad) > 0, F.slice(bad, 1, 1)).when(level.isNull(), F.array(F.lit("confidence missing"))).otherwise(rules)
