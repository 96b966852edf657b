"""Rule sets and decisions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lookup, or_zero, truthy
from ..schema import ARP, CLASS_NAMES, DHCP, DNS, GATEWAY, NORMAL, SHORT_NAMES

# Rule thresholds.
DISCOVER_LIMIT = 10
ACK_SHARE = 0.5
DNS_FAILURE_SHARE = 0.5
DNS_QUERY_LIMIT = 5
ARP_LIMIT = 50
ARP_SOFT_LIMIT = 20
BROADCAST_SHARE = 0.3
GATEWAY_LIMIT = 3


@dataclass(frozen=True)
class Rule:
    """A named condition and the label it gives; users add rules by adding these."""

    name: str
    condition: Column
    label: int


def conditions(df: DataFrame) -> dict[str, Column]:
    """The four basic conditions over whatever feature columns `df` has."""
    discover, ack = or_zero(df, "dhcp_discover_count"), or_zero(df, "dhcp_ack_count")
    arp, broadcast = or_zero(df, "arp_request_count"), or_zero(df, "broadcast_packet_ratio")
    return {
        "DHCP_MISCONFIG": (discover > DISCOVER_LIMIT) & (ack < discover * ACK_SHARE),
        "DNS_MISCONFIG": (or_zero(df, "dns_failure_ratio") > DNS_FAILURE_SHARE)
        & (or_zero(df, "dns_query_count") > DNS_QUERY_LIMIT),
        "ARP_STORM": (arp > ARP_LIMIT) | ((broadcast > BROADCAST_SHARE) & (arp > ARP_SOFT_LIMIT)),
        "GATEWAY_MISCONFIG": or_zero(df, "num_distinct_gateways") > GATEWAY_LIMIT,
    }


LABELS = {"DHCP_MISCONFIG": DHCP, "DNS_MISCONFIG": DNS, "ARP_STORM": ARP, "GATEWAY_MISCONFIG": GATEWAY}

# The orders in which rule sets try their rules.
DETECTOR_ORDER = ("DHCP_MISCONFIG", "DNS_MISCONFIG", "ARP_STORM", "GATEWAY_MISCONFIG")
PSEUDO_LABEL_ORDER = ("DNS_MISCONFIG", "DHCP_MISCONFIG", "GATEWAY_MISCONFIG", "ARP_STORM")


def rule_set(df: DataFrame, order: Sequence[str] = DETECTOR_ORDER) -> list[Rule]:
    tests = conditions(df)
    return [Rule(name, tests[name], LABELS[name]) for name in order]


def first_match(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Label and name of the first rule that holds."""
    label = name = None
    for rule in rules:
        test = truthy(rule.condition)
        label = F.when(test, rule.label) if label is None else label.when(test, rule.label)
        name = F.when(test, rule.name) if name is None else name.when(test, rule.name)
    return label.otherwise(NORMAL), name.otherwise("NORMAL")


def detect(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """RUL1: the first matching rule per row; confidence 1 when one fires, else 0."""
    label, name = first_match(rules or rule_set(df))
    return df.withColumns({"predicted_label": label, "rule_name": name}).withColumn(
        "confidence", F.when(F.col("predicted_label") != 0, 1.0).otherwise(0.0)
    )


def pseudo_labels(df: DataFrame) -> DataFrame:
    """RUL2: training labels from rules, DNS first."""
    return df.withColumn("label", first_match(rule_set(df, PSEUDO_LABEL_ORDER))[0])


def graded(df: DataFrame) -> DataFrame:
    """RUL3: label, confidence and name, confidence growing with severity.

    DHCP is tried first; DNS replaces a normal verdict, or a DHCP one when most queries
    fail; gateway and ARP only speak where nothing else has.
    """
    discover = or_zero(df, "dhcp_discover_count").cast("double")
    queries = or_zero(df, "dns_query_count").cast("double")
    failures = or_zero(df, "dns_failure_count").cast("double")
    arp = or_zero(df, "arp_request_count").cast("double")
    ratio = F.coalesce(F.try_divide(failures, F.when(queries > 0, queries)), F.lit(0.0))
    tests = conditions(df)
    dhcp = tests["DHCP_MISCONFIG"]
    dns = (ratio > DNS_FAILURE_SHARE) & (queries > DNS_QUERY_LIMIT) & (~dhcp | (ratio > 0.7))

    def grade(label: int, confidence: Column, name: str) -> Column:
        return F.struct(F.lit(label).alias("label"), confidence.alias("confidence"), F.lit(name).alias("name"))

    verdict = (
        F.when(dns, grade(DNS, F.lit(0.70) + F.least(ratio, F.lit(1.0)) * 0.20, "DNS_MISCONFIG"))
        .when(dhcp, grade(DHCP, F.lit(0.75) + F.least(discover / 20.0, F.lit(1.0)) * 0.15, "DHCP_MISCONFIG"))
        .when(tests["GATEWAY_MISCONFIG"], grade(GATEWAY, F.lit(0.80), "GATEWAY_MISCONFIG"))
        .when(tests["ARP_STORM"], grade(ARP, F.lit(0.75) + F.least(arp / 100.0, F.lit(1.0)) * 0.15, "ARP_STORM"))
        .otherwise(grade(NORMAL, F.lit(0.85), "Normal"))
    )
    return df.withColumn("_g", verdict).select(
        *df.columns,
        F.col("_g.label").alias("rule_prediction"),
        F.col("_g.confidence").alias("rule_confidence"),
        F.col("_g.name").alias("rule_name"),
    )


def hybrid(
    df: DataFrame,
    ml_prediction: str = "ml_prediction",
    ml_confidence: str = "ml_confidence",
    rule_prediction: str = "rule_prediction",
    rule_confidence: str = "rule_confidence",
) -> DataFrame:
    """RUL5: one decision from a model's and the graded rules' verdicts."""
    m_label, m = F.col(ml_prediction), F.col(ml_confidence)
    r_label, r = F.col(rule_prediction), F.col(rule_confidence)
    reliable = r_label.isin(DNS, DHCP)
    rule_weight = F.when(reliable, 0.6).otherwise(0.4)
    sure_rule = (r > 0.8) & (m < 0.6)
    agree = r_label == m_label

    def decide(label: Column, confidence: Column, method: str) -> Column:
        return F.struct(label.cast("int").alias("label"), confidence.alias("confidence"), F.lit(method).alias("method"))

    decision = (
        F.when(sure_rule & (reliable | (r > 0.85)), decide(r_label, r, "rule_based_override"))
        .when(sure_rule, decide(m_label, r * 0.4 + m * 0.6, "weighted_average"))
        .when(agree, decide(m_label, F.least(F.lit(0.95), m + 0.1), "combined_agreement"))
        .when(reliable & (r > 0.75), decide(r_label, r * 0.9, "rule_based_preferred"))
        .when((m > 0.7) & (r < 0.7), decide(m_label, m, "ml_preferred"))
        .when(r * rule_weight > m * (1 - rule_weight), decide(r_label, r, "weighted_rule_based"))
        .otherwise(decide(m_label, m, "weighted_ml"))
    )
    return df.withColumn("_d", decision).select(
        *df.columns,
        F.col("_d.label").alias("prediction"),
        F.col("_d.confidence").alias("confidence"),
        F.col("_d.method").alias("method"),
    )


def method_of_model_only(df: DataFrame, ml_prediction: str = "ml_prediction", ml_confidence: str = "ml_confidence") -> DataFrame:
    """The same columns as `hybrid` when rules are switched off."""
    return df.withColumns(
        {"prediction": F.col(ml_prediction).cast("int"), "confidence": F.col(ml_confidence), "method": F.lit("ml_only")}
    )


def rule_only(df: DataFrame) -> DataFrame:
    """RUL4: graded rules as the whole decision."""
    return graded(df).withColumns(
        {
            "prediction": F.col("rule_prediction"),
            "prediction_name": label_name(F.col("rule_prediction")),
            "confidence": F.col("rule_confidence"),
            "method": F.lit("rule_based"),
        }
    )


def label_name(label: Column, names: Mapping[int, str] = SHORT_NAMES) -> Column:
    return lookup(names, label.cast("int"), F.concat(F.lit("Label "), label.cast("string")))


def class_probabilities(df: DataFrame, keys: Sequence[str], probabilities: str, classes: Sequence[int]) -> DataFrame:
    """RUL11: one row per class with its name; the classes come from the model, not from the array's length."""
    ids = F.array(*[F.lit(int(c)) for c in classes])
    return (
        df.select(*keys, F.posexplode(probabilities).alias("_i", "probability"))
        .withColumn("class_id", F.get(ids, F.col("_i")))
        .where(F.col("class_id").isNotNull())
        .select(*keys, "class_id", lookup(CLASS_NAMES, F.col("class_id"), F.concat(F.lit("Class "), F.col("class_id"))).alias("class_name"), "probability")
    )


def classes_by_count(count: int) -> list[int]:
    """The class ids assumed for a probability array of unknown origin: 2 slots, 3 slots, else from 0 up."""
    return [0, 2] if count == 2 else list(range(min(count, 5)))


# How each decision method is shown.
METHOD_NAMES = {
    "ml_only": "ML",
    "rule_based_override": "Rule-Based",
    "combined_agreement": "ML+Rule",
    "rule_based_preferred": "Rule-Based",
    "ml_preferred": "ML",
    "weighted_average": "Hybrid",
    "weighted_rule_based": "Hybrid",
    "weighted_ml": "Hybrid",
    "rule_based": "Rule-Based",
}


def result_table(df: DataFrame) -> DataFrame:
    """RUL10: scored rows as shown to a reader; errors are cut to 200 characters."""
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    failed = error.isNotNull()
    known = F.col("prediction").isNotNull()

    def pick(on_error: Column, shown: Column, otherwise: Column) -> Column:
        return F.when(failed, on_error).when(known, shown).otherwise(otherwise)

    nothing = F.lit(None).cast("string")
    percent = F.format_string("%.1f%%", F.col("confidence") * 100)
    status = F.when(F.col("prediction") == 0, "Normal").otherwise("Misconfigured")
    return df.select(
        F.coalesce(F.col("device_id").cast("string"), F.lit("N/A")).alias("device_id"),
        F.coalesce(F.col("time_window").cast("string"), F.lit("N/A")).alias("time_window"),
        pick(F.lit("Error"), label_name(F.col("prediction")), F.lit("Unknown")).alias("prediction"),
        pick(F.lit("N/A"), percent, F.lit("N/A")).alias("confidence"),
        pick(nothing, lookup(METHOD_NAMES, F.col("method"), F.lit("Unknown")), nothing).alias("method"),
        pick(F.lit("Error"), status, F.lit("Unknown")).alias("status"),
        F.substring(error, 1, 200).alias("error"),
    )


def choose_source(available: Sequence[str]) -> str:
    """RUL9: the predictions a report is made from."""
    for name in ("open_set", "multi_view", "baseline_classifier"):
        if name in available:
            return name
    raise ValueError("no predictions available")
