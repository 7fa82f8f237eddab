"""Decision columns: tier labels and bands, fused score, risk level, reasons, softmax."""

from pyspark.sql import functions as F

from lurewatch import constants as K


def label(score):
    return F.when(score >= K.LABEL_CUT, K.PHISHING).otherwise(K.BENIGN)


def confidence(score, threshold=K.CONFIDENCE_THRESHOLD):
    sure = (score >= F.lit(threshold)) | (score <= F.lit(1.0 - threshold))
    return F.when(sure, "high").otherwise("low")


def tier_result(score, metadata, threshold=K.CONFIDENCE_THRESHOLD):
    """struct<score, label, confidence, escalate, metadata> of one tier."""
    band = confidence(score, threshold)
    return F.struct(
        score.alias("score"),
        label(score).alias("label"),
        band.alias("confidence"),
        (band == "low").alias("escalate"),
        metadata.alias("metadata"),
    )


def url_metadata(top_features, threshold=K.CONFIDENCE_THRESHOLD):
    return F.struct(
        F.lit(1).alias("tier"),
        F.lit(K.URL_MODEL_NAME).alias("model"),
        F.lit(float(threshold)).alias("threshold"),
        top_features.alias("top_features"),
    )


def text_metadata(text, threshold=K.CONFIDENCE_THRESHOLD):
    return F.struct(
        F.lit(2).alias("tier"),
        F.lit(K.TEXT_MODEL_NAME).alias("model"),
        F.lit(float(threshold)).alias("threshold"),
        F.char_length(text).alias("text_length"),
    )


def top_features(importances, n=5):
    """The ``n`` features that weigh most in the model, with the values they have in the row.

    ``importances`` is a list of (feature, importance) in model order. The ranking is a property of the
    model, so it is settled here and the plan only carries a projection.
    """
    ranked = sorted(importances, key=lambda pair: -pair[1])[:n]
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(name).cast("double").alias("value"),
                F.lit(float(weight)).alias("importance"),
            )
            for name, weight in ranked
        ]
    )


def in_unit_range(score):
    # NaN sorts above every number, so the comparison refuses it as well.
    return score.between(F.lit(0.0), F.lit(1.0))


def is_uncertain(score, zone=K.UNCERTAIN_ZONE):
    return score.between(F.lit(float(zone[0])), F.lit(float(zone[1])))


def risk_level(score):
    low, medium = K.RISK_CUTS
    return F.when(score < low, "Low").when(score < medium, "Medium").otherwise("High")


def fusion_result(score1, score2, weights=(1.0, 1.0), zone=K.UNCERTAIN_ZONE):
    """struct of the fused verdict; a tier that did not run has a null score."""
    w1, w2 = map(float, weights)
    if w1 + w2 == 0:
        raise ValueError("the weights must not add up to zero")
    both = score1.isNotNull() & score2.isNotNull()
    mean = (F.lit(w1) * score1 + F.lit(w2) * score2) / F.lit(w1 + w2)
    score = F.when(both, mean).otherwise(F.coalesce(score1, score2))
    method = (
        F.when(both, "weighted_average").when(score1.isNotNull(), "tier1_only").otherwise("tier2_only")
    )
    # A tier that did not run does not stand against an escalation.
    escalate = F.coalesce(is_uncertain(score1, zone), F.lit(True)) & F.coalesce(
        is_uncertain(score2, zone), F.lit(True)
    )
    return F.struct(
        score.alias("score"),
        label(score).alias("label"),
        risk_level(score).alias("risk_level"),
        F.when(escalate, "low").otherwise("high").alias("confidence"),
        escalate.alias("escalate"),
        F.struct(
            score1.alias("tier1_score"),
            score2.alias("tier2_score"),
            F.array(F.lit(w1), F.lit(w2)).alias("weights"),
            method.alias("fusion_method"),
        ).alias("metadata"),
    )


def fusion_reasons(score1, score2, risk):
    """array<string>: one sentence for each tier that ran, then the combined risk."""
    moderate, high = K.REASON_CUTS

    def sentence(source, score):
        level = F.when(score > high, "high").when(score > moderate, "moderate").otherwise("low")
        # format_number rounds ties as the decimal text of the double does.
        text = F.concat(
            F.lit(f"{source} analysis shows "), level, F.lit(" phishing risk (score: "),
            F.format_number(score, 2), F.lit(")"),
        )
        return F.when(score.isNotNull(), text)

    return F.array_compact(
        F.array(sentence("URL", score1), sentence("Text", score2), F.concat(F.lit("Combined risk level: "), risk))
    )


def softmax_of_two(logit0, logit1):
    """Probability of class 1 from two logits; the larger one is taken off first so nothing overflows."""
    top = F.greatest(logit0, logit1)
    e0, e1 = F.exp(logit0 - top), F.exp(logit1 - top)
    return e1 / (e0 + e1)
