"""Named checks with their report order, and the ten published export files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.labels import SPANISH_EXPORT
from ledgersift.model import Ledger
from ledgersift.plans import checks, consolidated, scorecard

Order = Callable[[], list[Column]]


@dataclass(frozen=True)
class Check:
    """A check and the order its report is read in."""

    build: Callable[[Ledger], DataFrame]
    order: Order
    summary: bool = False

    def ordered(self, ledger: Ledger) -> DataFrame:
        return self.sorted(ledger, "all")

    def sorted(self, ledger: Ledger, sort: str) -> DataFrame:
        return ordered(self.build(ledger), self.order(), sort)


def ordered(df: DataFrame, order: list[Column], sort: str = "all") -> DataFrame:
    """Sort for a report: ``all`` rows, rows within their ``parts``, or ``none``.

    Sorting all rows is a range shuffle. Equal rows are told apart by where they come from, so it
    stays balanced when many rows share all sort values.
    """
    if sort == "none":
        return df
    if sort == "parts":
        return df.sortWithinPartitions(*order)
    return df.withColumn("_origin", F.spark_partition_id()).orderBy(*order, "_origin").drop("_origin")


CHECKS: dict[str, Check] = {
    "duplicate_emails": Check(checks.duplicate_emails, lambda: [F.desc("n"), F.asc("email")]),
    "duplicate_email_rate": Check(checks.duplicate_email_rate, lambda: [F.asc("total")], True),
    "orders_without_customer": Check(checks.orders_without_customer, lambda: [F.asc("order_id")]),
    "orders_without_customer_rate": Check(checks.orders_without_customer_rate, lambda: [F.asc("total")], True),
    "completed_without_payment": Check(checks.completed_without_payment,
                                       lambda: [F.desc_nulls_last("total_amount"), F.asc("order_id")]),
    "completed_without_payment_risk": Check(checks.completed_without_payment_risk, lambda: [F.asc("n")], True),
    "orphan_payments": Check(checks.orphan_payments,
                             lambda: [F.desc_nulls_first("payment_amount"), F.asc("payment_id")]),
    "orphan_payment_amount": Check(checks.orphan_payment_amount, lambda: [F.asc("n")], True),
    "amount_mismatches": Check(checks.amount_mismatches,
                               lambda: [F.abs(F.col("diff")).desc(), F.asc("order_id"), F.asc("paid_amount")]),
    "amount_mismatch_summary": Check(checks.amount_mismatch_summary, lambda: [F.asc("n")], True),
    "revenue_at_risk": Check(scorecard.revenue_at_risk,
                             lambda: [F.desc_nulls_first("amount"), F.asc("category")], True),
    "quality_score": Check(scorecard.quality_score,
                           lambda: [F.asc_nulls_last("score"), F.asc("table_name")], True),
    "customers_with_nulls": Check(checks.customers_with_nulls, lambda: [F.asc("customer_id")]),
    "orders_with_null_total": Check(checks.orders_with_null_total, lambda: [F.asc("order_id")]),
    "null_census": Check(checks.null_census, lambda: [F.desc("n"), F.asc("check_name")], True),
    "inactive_product_orders": Check(checks.inactive_product_orders,
                                     lambda: [F.desc_nulls_first("order_date"), F.asc("order_id")]),
    "inactive_product_summary": Check(checks.inactive_product_summary, lambda: [F.asc("n")], True),
    "consolidated_view": Check(consolidated.consolidated_view,
                               lambda: [F.asc("order_id"), F.asc_nulls_last("paid_amount")]),
    "ledger_kpis": Check(scorecard.ledger_kpis, lambda: [F.asc("orders")], True),
    "reconciliation": Check(checks.reconciliation, lambda: [F.abs(F.col("diff")).desc(), F.asc("order_id")]),
}


@dataclass(frozen=True)
class Export:
    """One published file: the check behind it, the result columns it takes and their headers."""

    check: str
    columns: tuple[str, ...]
    headers: tuple[str, ...]
    build: Callable[[Ledger], DataFrame] | None = None

    def ordered(self, ledger: Ledger) -> DataFrame:
        """The check under the published wording and headers, in report order."""
        return self.sorted(ledger, "all")

    def sorted(self, ledger: Ledger, sort: str) -> DataFrame:
        check = CHECKS[self.check]
        worded = ledger.worded(SPANISH_EXPORT)
        return (ordered((self.build or check.build)(worded), check.order(), sort)
                .select(*[F.col(c).alias(h) for c, h in zip(self.columns, self.headers, strict=True)]))

    @property
    def summary(self) -> bool:
        return CHECKS[self.check].summary


def _worded_census(ledger: Ledger) -> DataFrame:
    return checks.null_census(ledger, full=False).withColumn(
        "check_name", F.concat("check_name", F.lit(" nulo")))


# File stems and headers of the published export, which dashboards import by name.
EXPORTS: dict[str, Export] = {
    "01_emails_duplicados": Export(
        "duplicate_emails",
        ("email", "n", "n_extra", "ids", "first_seen", "last_seen"),
        ("email", "total_ocurrencias", "duplicados_extra", "customer_ids", "primer_registro",
         "ultimo_duplicado"), checks.duplicate_email_listing),
    "02_ordenes_sin_cliente": Export(
        "orders_without_customer",
        ("order_id", "referenced_customer_id", "order_date", "status", "total_amount", "problem"),
        ("order_id", "customer_id_referenciado", "order_date", "status", "total_amount",
         "descripcion_problema")),
    "03_completadas_sin_pago": Export(
        "completed_without_payment",
        ("order_id", "customer_id", "customer_name", "order_date", "total_amount", "problem"),
        ("order_id", "customer_id", "nombre_cliente", "order_date", "total_amount",
         "descripcion_problema")),
    "04_pagos_huerfanos": Export(
        "orphan_payments",
        ("payment_id", "referenced_order_id", "payment_date", "payment_amount", "payment_status", "problem"),
        ("payment_id", "order_id_referenciado", "payment_date", "payment_amount", "payment_status",
         "descripcion_problema")),
    "05_diferencia_monetaria": Export(
        "amount_mismatches",
        ("order_id", "customer_id", "customer_name", "order_date", "order_amount", "paid_amount", "diff",
         "diff_type", "diff_pct"),
        ("order_id", "customer_id", "nombre_cliente", "order_date", "monto_orden", "monto_pagado",
         "discrepancia_cop", "tipo_discrepancia", "discrepancia_pct")),
    "06_revenue_at_risk": Export(
        "revenue_at_risk",
        ("category", "n", "amount"),
        ("categoria_riesgo", "registros_afectados", "monto_riesgo_cop")),
    "07_data_quality_score": Export(
        "quality_score",
        ("table_name", "total", "bad", "pct", "score"),
        ("nombre_tabla", "total_registros", "registros_con_problemas", "pct_con_problemas", "quality_score")),
    "08_campos_nulos_criticos": Export(
        "null_census",
        ("check_name", "n"),
        ("verificacion", "registros_afectados"), _worded_census),
    "09_ordenes_producto_inactivo": Export(
        "inactive_product_orders",
        ("order_id", "customer_id", "customer_name", "order_date", "status", "total_amount", "product_id",
         "product_name", "product_price", "problem"),
        ("order_id", "customer_id", "nombre_cliente", "order_date", "status", "total_amount", "product_id",
         "product_name", "precio_producto", "descripcion_problema")),
    "10_auditoria_consolidada": Export(
        "consolidated_view",
        ("order_id", "customer_id", "customer_name", "order_date", "status", "total_amount", "paid_amount",
         "product_name", "product_active", "no_customer", "no_payment", "amount_mismatch", "null_total",
         "inactive_product", "diff"),
        ("order_id", "customer_id", "nombre_cliente", "order_date", "status", "total_amount", "monto_pagado",
         "product_name", "producto_activo", "flag_cliente_inexistente", "flag_sin_pago",
         "flag_monto_desajustado", "flag_total_nulo", "flag_producto_inactivo", "discrepancia_cop")),
}
