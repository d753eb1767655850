"""Registered rule queries: resolution, provenance, ignore list, crosswalk, keys, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import analysis as A
from ledgerline.operators import reconcile as RC
from ledgerline.operators import rules as R
from ledgerline.plans import invoices as I
from ledgerline.plans import oracle_invoices as OI
from ledgerline.plans import oracle_x12 as OX
from ledgerline.plans import x12docs as X
from ledgerline.plans.queries import register

_INV = "WITH " + OI.INVOICE_CTES.strip()


def _flat_fields(spark, sf):
    out = None
    for side in ("source", "target"):
        r = I.invoice_records(spark, sf, side).select(F.explode("fields.field").alias("field"))
        out = r if out is None else out.unionByName(r)
    return out.distinct().select(F.lit("*").alias("rule_segment"), "field")


def _rule_case(alias: str, attr: str, default: str) -> str:
    return (f"CASE WHEN {alias}1.segment IS NOT NULL THEN {alias}1.{attr} WHEN {alias}2.segment IS NOT NULL THEN {alias}2.{attr} "
            f"WHEN {alias}3.segment IS NOT NULL THEN {alias}3.{attr} WHEN {alias}4.segment IS NOT NULL THEN {alias}4.{attr} "
            f"ELSE {default} END")


def _resolve_sql(keys: str, merged: str, seg: str = "rule_segment") -> str:
    attrs = [("severity", "'hard'"), ("ignore_case", "FALSE"), ("numeric", "FALSE"),
             ("conditional_qualifier", "NULL"), ("amount_variance", "NULL")]
    cols = ",\n  ".join(f"{_rule_case('r', a, d)} AS {a}" for a, d in attrs)
    return f"""SELECT k.*, {cols},
  (r1.segment IS NULL AND (r2.segment IS NULL OR k.{seg} = '*') AND (r3.segment IS NULL OR k.field = '*')) AS wildcard
FROM ({keys}) k
LEFT JOIN ({merged}) r1 ON r1.segment = k.{seg} AND r1.field = k.field
LEFT JOIN ({merged}) r2 ON r2.segment = k.{seg} AND r2.field = '*'
LEFT JOIN ({merged}) r3 ON r3.segment = '*' AND r3.field = k.field
LEFT JOIN ({merged}) r4 ON r4.segment = '*' AND r4.field = '*'"""


_FLAT_KEYS = "SELECT DISTINCT '*' AS rule_segment, field FROM (SELECT field FROM s_f UNION ALL SELECT field FROM t_f)"


@register("rules_effective", _INV + "\n" + _resolve_sql(_FLAT_KEYS, OI.merged_rules_sql(I.profile_rules(1))))
def rules_effective(spark, sf):
    """The rule every field of the invoices resolves to, with the wildcard flag."""
    book = I.profile_rules(1)
    merged = R.merge_tiers(R.rules_frame(spark, book))
    return R.resolve(_flat_fields(spark, sf), merged, star_rule=R.star_of(book), n_rules=len(book.rules)).drop("hit")


_X12_KEYS = """SELECT DISTINCT segment AS rule_segment, segment || lpad(CAST(i AS VARCHAR), 2, '0') AS field
FROM (SELECT * FROM sx_seg UNION ALL SELECT * FROM tx_seg), LATERAL (SELECT unnest(range(1, len(elements))) AS i)
WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA')"""


@register("rules_effective_x12", OX.segments_sql() + _resolve_sql(_X12_KEYS, OI.merged_rules_sql(X.x12_rules())))
def rules_effective_x12(spark, sf):
    """C17 C19 on X12: segment rules, segment wildcards and field wildcards for every element seen."""
    keys = None
    for side in ("source", "target"):
        tx = X.parsed_transactions(spark, sf, side)
        k = tx.select(F.col("segment").alias("rule_segment"),
                      F.posexplode(F.slice("elements", 2, F.greatest(F.size("elements") - 1, F.lit(0)))).alias("i", "_v"))
        k = k.select("rule_segment", F.concat("rule_segment", F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("field"))
        keys = k if keys is None else keys.unionByName(k)
    book = X.x12_rules()
    merged = R.merge_tiers(R.rules_frame(spark, book))
    return R.resolve(keys.distinct(), merged, star_rule=R.star_of(book), n_rules=len(book.rules)).drop("hit")


def _tier_sql(keys: str) -> str:
    tiers = ["partner", "transaction", "universal"]
    vals = OI.rules_values(I.profile_rules(1))
    joins, hits = [], []
    for t in tiers:
        m = f"(SELECT * FROM ({vals}) WHERE tier = '{t}')"
        joins.append(f"""LEFT JOIN {m} {t[0]}1 ON {t[0]}1.segment = k.rule_segment AND {t[0]}1.field = k.field
LEFT JOIN {m} {t[0]}2 ON {t[0]}2.segment = k.rule_segment AND {t[0]}2.field = '*'
LEFT JOIN {m} {t[0]}3 ON {t[0]}3.segment = '*' AND {t[0]}3.field = k.field
LEFT JOIN {m} {t[0]}4 ON {t[0]}4.segment = '*' AND {t[0]}4.field = '*'""")
        hits.append(f"({t[0]}1.segment IS NOT NULL OR {t[0]}2.segment IS NOT NULL OR {t[0]}3.segment IS NOT NULL "
                    f"OR {t[0]}4.segment IS NOT NULL)")
    tier = "CASE " + " ".join(f"WHEN {h} THEN '{t}'" for h, t in zip(hits, tiers)) + " ELSE 'default' END"
    attrs = [("severity", "'hard'"), ("ignore_case", "FALSE"), ("numeric", "FALSE"),
             ("conditional_qualifier", "NULL"), ("amount_variance", "NULL")]
    cols = []
    for a, d in attrs:
        cols.append("CASE " + " ".join(f"WHEN {h} THEN {_rule_case(t[0], a, d)}" for h, t in zip(hits, tiers))
                    + f" ELSE {d} END AS {a}")
    return f"SELECT k.*, {tier} AS tier, " + ", ".join(cols) + f" FROM ({keys}) k\n" + "\n".join(joins)


@register("rules_provenance", _INV + "\n" + _tier_sql(_FLAT_KEYS))
def rules_provenance(spark, sf):
    """Resolution tier first, wildcards inside the tier, with the tier that answered."""
    book = I.profile_rules(1)
    return R.resolve_with_tier(_flat_fields(spark, sf), R.rules_frame(spark, book), seg_col="rule_segment",
                               field_col="field", stars={t: R.star_of(book, tier=t) for t in R.TIER_RANK})


@register("ignore_filter", OI.base_sql(1) + """SELECT pair_id, CASE WHEN section = 'line' THEN 'line_' || occ ELSE section END AS segment,
  field, s AS source_value, t AS target_value
FROM fj f WHERE coalesce(s, '') <> coalesce(t, '')
  AND (section <> 'line' OR EXISTS (SELECT 1 FROM s_lines a JOIN t_lines b USING (pair_id, occ)
                                     WHERE a.pair_id = f.pair_id AND a.occ = f.occ))
  AND EXISTS (SELECT 1 FROM ig i WHERE (i.segment = '*' AND (i.field = f.field OR i.field = '*'))
                                    OR (i.segment = '*' AND i.field = f.field))""")
def ignore_filter(spark, sf):
    """The field differences the merged ignore list removes before rules are looked at."""
    tiered = I.profile_rules(1)
    cand = I.aligned(spark, sf, ())[1].filter(~F.col("presence"))
    kept = R.drop_ignored(cand, R.ignores_frame(spark, tiered))
    key = ["pair_id", "label", "field"]
    return (cand.join(kept.select(*key), key, "left_anti")
                .select("pair_id", F.col("label").alias("segment"), "field", F.col("s").alias("source_value"),
                        F.col("t").alias("target_value")))


# A profile crosswalk (partial rows inherit the tier attributes).
CROSSWALK = [
    {"segment": "*", "field": "quantity", "severity": "soft"},
    {"segment": "*", "field": "ship_date", "severity": "ignore"},
    {"segment": "*", "field": "line_count", "severity": "soft", "numeric": True},
    {"segment": "*", "field": "total", "amount_variance": 2.0},
]


@register("crosswalk_apply", OI.base_sql(1, CROSSWALK) + "SELECT * FROM diffs")
def crosswalk_apply(spark, sf):
    """C20: the invoice run with the profile crosswalk on top of the three tiers."""
    return I.flat_run(spark, sf, 1, CROSSWALK)[1]


@register("match_keys", "WITH " + OI.INVOICE_CTES.strip() + """
SELECT 'source' AS side, doc_id, 0 AS tx_index, match_value FROM s_k
UNION ALL SELECT 'target', doc_id, 0, match_value FROM t_k""")
def match_keys(spark, sf):
    """Match values from a header path, normalised by regex (``^INV-`` removed)."""
    out = None
    for side in ("source", "target"):
        k = RC.match_values_flat(I.invoice_records(spark, sf, side), I.MATCH_KEY).withColumn("side", F.lit(side))
        out = k if out is None else out.unionByName(k)
    return out.select("side", "doc_id", "tx_index", "match_value")


def _totals(status: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {n}" for k, n in (
        ("MATCH", "matched"), ("MISMATCH", "mismatched"), ("UNMATCHED", "unmatched")))
    return f"SELECT count(*) AS total_pairs, {counts} FROM {status}"


@register("run_listing", OI.base_sql(1, extra_versions=(2,)) + f""",
st2 AS (SELECT p.*, CASE WHEN source_file IS NULL OR target_file IS NULL THEN 'UNMATCHED'
          WHEN coalesce(d.n, 0) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status
        FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM diffs_v2 GROUP BY pair_id) d USING (pair_id)),
runs AS (
  SELECT 1 AS run_id, 'invoices' AS profile, * FROM ({_totals("status")})
  UNION ALL SELECT 2, 'invoices', * FROM ({_totals("st2")}))
SELECT * FROM runs ORDER BY run_id DESC LIMIT 50""")
def run_listing(spark, sf):
    """History of the full runs, newest first, paged (two runs: rules v1 and v2)."""
    runs = I.run_store(spark, sf).runs().where("reclassified_from is null")
    return A.listing(runs, "run_id", 0, 50).select("run_id", "profile", "total_pairs", "matched", "mismatched", "unmatched")
