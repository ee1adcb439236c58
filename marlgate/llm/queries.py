"""Queries p4 and p8 to p10. SQL says p4 row by row. It can't say tokens, keys and names: there SQL holds what must be true of every
result (``p8_audit``, ``p9_audit``, ``p10_audit``), and tests hold the rest against brute force, round trips and labelled sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.llm import mixing, packing, pii, survivorship, tokens
from marlgate.plans.data_queries import REPORT_FIGURES, reports_sql
from marlgate.session import cut
from marlgate.sources.testbed import table

Query = Callable[[SparkSession, str], DataFrame]


def survivor_values(income: DataFrame) -> DataFrame:
    best = survivorship.surviving_reports(income)
    return best.select(*survivorship.RECORD, "n_rows", *[F.col(f"{f}.value").alias(f) for f in survivorship.FIGURES])


def sized(spark: SparkSession, folder: str, weigh: bool = False) -> DataFrame:
    return cut(tokens.token_sizes(table(spark, folder, "documents"), weigh=weigh))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(sized(spark, folder), packing.container_kinds(table(spark, folder, "containers")))


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """The report of both orders: largest first, as ``p8_packed``, and as the texts happen to come."""
    sizes, kinds = sized(spark, folder), packing.container_kinds(table(spark, folder, "containers"))
    both = [packing.fill_report(packing.pack(sizes, kinds, largest_first=x)).withColumn("placed", F.lit(n)) for x, n in ((True, "largest first"), (False, "as they come"))]
    return both[0].unionByName(both[1])


def packing_audit(spark: SparkSession, folder: str) -> DataFrame:
    """By container: documents placed, and what must be none: windows beyond capacity, needless splits, tokens lost or doubled."""
    sizes = sized(spark, folder)
    placed = cut(packing.pack(sizes, packing.container_kinds(table(spark, folder, "containers"))))
    return packing.audit(placed, sizes)


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(sized(spark, folder, weigh=True), mixing.target_rows(table(spark, folder, "mix_targets")))


def mixing_audit(spark: SparkSession, folder: str) -> DataFrame:
    sizes, targets = sized(spark, folder, weigh=True), mixing.target_rows(table(spark, folder, "mix_targets"))
    return mixing.audit(mixing.mix(sizes, targets), sizes, targets)


def finding_audit(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.audit(documents, cut(pii.find_personal(documents, table(spark, folder, "known_names"))))


def queries() -> dict[str, Query]:
    return {
        "p4_found": lambda spark, folder: survivorship.supplying_rows(table(spark, folder, "income")),
        "p4_survivors": lambda spark, folder: survivor_values(table(spark, folder, "income")),
        "p8_packed": packed,
        "p8_fill": fills,
        "p8_audit": packing_audit,
        "p9_mixture": mixture,
        "p9_shares": lambda spark, folder: mixing.share_report(mixture(spark, folder), table(spark, folder, "mix_targets")),
        "p9_audit": mixing_audit,
        "p10_found": lambda spark, folder: pii.find_personal(table(spark, folder, "documents"), table(spark, folder, "known_names")),
        "p10_audit": finding_audit,
        "p10_redacted": lambda spark, folder: pii.redact_personal(table(spark, folder, "documents"), table(spark, folder, "known_names")),
    }


def best_fields_sql() -> str:
    return " UNION ALL ".join(
        f"(SELECT ts_code, end_date, report_type, '{f}' AS field_name, row_id, {f} AS value FROM reports WHERE {f} IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY ts_code, end_date, report_type ORDER BY known DESC NULLS LAST, updated DESC, source_order DESC NULLS LAST, row_id) = 1)"
        for f in REPORT_FIGURES
    )


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"max(value) FILTER (field_name = '{f}') AS {f}" for f in REPORT_FIGURES)
    none = lambda *names: ", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in names)
    return {
        "p4_found": f"WITH {reports_sql()}, several AS (SELECT ts_code, end_date, report_type FROM reports GROUP BY ALL HAVING count(*) >= 2), best AS ({best_fields_sql()}) "
        "SELECT b.ts_code, b.end_date, b.report_type, field_name, row_id FROM best b JOIN several s ON b.ts_code = s.ts_code AND b.end_date = s.end_date AND b.report_type IS NOT DISTINCT FROM s.report_type",
        "p4_survivors": f"WITH {reports_sql()}, best AS ({best_fields_sql()}), groups AS (SELECT ts_code, end_date, report_type, count(*) AS n_rows FROM reports GROUP BY ALL) "
        f"SELECT g.ts_code, g.end_date, g.report_type, any_value(n_rows) AS n_rows, {values} "
        "FROM groups g LEFT JOIN best b ON b.ts_code = g.ts_code AND b.end_date = g.end_date AND b.report_type IS NOT DISTINCT FROM g.report_type GROUP BY 1, 2, 3",
        "p8_audit": f"SELECT container, capacity_tokens AS capacity, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents, {none('overfull', 'split_needlessly', 'wrongly_placed')} FROM containers",
        "p10_audit": f"SELECT count(DISTINCT doc_id) AS documents, {none('not_in_text', 'of_no_kind', 'named_twice')} FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
        "p9_audit": f"SELECT source, target_share, max_repeat, {none('beyond_repeat', 'uneven_epochs', 'texts_missed')} FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE length(text) > 0)",
    }
