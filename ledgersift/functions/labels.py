"""Wording of the descriptions the audit writes into its results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Labels:
    """One wording set; every operator that writes text takes it from here."""

    customer_missing: str = "Customer not found in customers"
    completed_unpaid: str = "Completed without a registered payment"
    order_missing: str = "Order not found in orders"
    overpaid: str = "Overpaid"
    underpaid: str = "Underpaid"
    risk_unpaid: str = "Completed orders without payment"
    risk_underpaid: str = "Underpaid orders"
    risk_overpaid: str = "Overpaid orders"
    risk_orphan: str = "Orphan payments"
    both_null: str = "Name and email missing"
    name_null: str = "Name missing"
    email_null: str = "Email missing"
    total_null: str = "total_amount is NULL"
    inactive_product: str = "Order for a discontinued product"
    currency: str = "COP"  # fixed value: the ledger's currency, after each sum of money in the report


ENGLISH = Labels()

# Wording of the published export files, which existing dashboards filter on.
SPANISH_EXPORT = Labels(
    customer_missing="Cliente no existe",
    completed_unpaid="Completada sin pago",
    order_missing="Orden no existe",
    overpaid="Overpaid",
    underpaid="Underpaid",
    risk_unpaid="Completadas sin pago",
    risk_underpaid="Underpaid (deficit cobro)",
    risk_overpaid="Overpaid (pasivo devolucion)",
    risk_orphan="Pagos huerfanos no conciliados",
    both_null="Falta nombre y email",
    name_null="Falta nombre",
    email_null="Falta email",
    total_null="total_amount es NULL",
    inactive_product="Producto descontinuado",
)
