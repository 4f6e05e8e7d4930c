"""A nine-order ledger with every semantic edge; expected results are in test_mini.py."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

from ledgersift.model import ROLE_SCHEMAS, Ledger


def day(n):
    return datetime(2024, 1, n)


CUSTOMERS = [
    (1, "Ana", "a@x", day(1)), (2, "Bo", "b@x", day(2)), (3, None, "a@x", day(3)),
    (4, None, None, day(4)), (5, "Eve", None, day(5)), (6, "Fay", "A@x", day(6)),
]
PRODUCTS = [(1, "P1", D("10.00"), True), (2, "P2", D("20.00"), False), (3, "P3", D("30.00"), None)]
ORDERS = [
    (1, 1, 1, day(1), "Completed", D("100.00")), (2, 2, 2, day(2), "Completed", D("200.00")),
    (3, 99, 1, day(3), "Completed", D("300.00")), (4, None, 3, day(4), "Pending", D("50.00")),
    (5, 1, 1, day(5), "Completed", None), (6, 2, 2, day(6), "Completed", D("400.00")),
    (7, 5, 1, day(7), "Completed", D("0.00")), (8, 6, 77, day(8), "Cancelled", D("80.00")),
    (9, 6, 1, day(9), "Completed", D("90.00")),
]
PAYMENTS = [
    (1, 1, day(1), D("100.00"), "Paid"), (2, 2, day(2), D("150.00"), "Paid"), (3, 2, day(2), D("50.00"), "Paid"),
    (4, 3, day(3), D("300.00"), "Failed"), (5, 500, day(5), D("70.00"), "Paid"),
    (6, None, day(6), D("30.00"), "Pending"), (7, 7, day(7), D("5.00"), "Paid"), (8, 8, day(8), None, "Paid"),
    (9, 9, day(9), D("95.00"), "Paid"),
]


def mini_ledger(spark, **options):
    tables = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS, "payments": PAYMENTS}
    return Ledger.of(**{r: spark.createDataFrame(rows, ROLE_SCHEMAS[r]) for r, rows in tables.items()}, **options)


def ledger_of(spark, customers=(), products=(), orders=(), payments=(), **options):
    tables = {"customers": customers, "products": products, "orders": orders, "payments": payments}
    return Ledger.of(**{r: spark.createDataFrame(list(rows), ROLE_SCHEMAS[r]) for r, rows in tables.items()},
                     **options)


def tuples(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
