"""Quality rules given as rows, for any tables: which rows break one, and the score of each table.

A rule names a table, a kind and a column. Rules of one table that ask the same question of another table (does this key
exist there?) share one lookup, so a table takes part in as many joins as it has distinct lookups, however many
rules it has:

* rules on a row's own columns are bits of a mask, worked out where the row is read;
* all lookups of a table but the last are joined to its rows, balanced under hot keys (``skew.resolve``);
* before the last one the rows are summed up by its key and their masks, so it joins keys to keys; a uniqueness
  rule in that place needs no join at all.

A row that breaks several rules counts once for its table and once for each rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgersift.functions.expressions import percent, rows, score
from ledgersift.operators.skew import NO_HOT_KEYS, SkewPolicy, hot_keys, key_set, resolve

NOT_NULL, UNIQUE, REFERENCES, FOREIGN_KEY, HAS_CHILD, DOMAIN, CONDITION = KINDS = (
    "not_null", "unique", "references", "foreign_key", "has_child", "domain", "condition")

RULE_SCHEMA = ("rule string, table_name string, kind string, column_name string, other_table string, "
               "other_column string, argument string, only_where string")


class RuleError(ValueError):
    """A rule that cannot be applied to the given tables."""


@dataclass(frozen=True)
class Rule:
    """One rule; a row breaks it when it is among those of ``only_where`` (all, if not given) and

    * ``not_null``: the column is NULL;
    * ``unique``: the column's value is not NULL and another row has it too;
    * ``references``: no row of ``other_table`` has the value in ``other_column``; NULL is never found;
    * ``foreign_key``: the same, but NULL passes;
    * ``has_child``: no row of ``other_table`` refers to the column's value in ``other_column``;
    * ``domain``: the value is none of ``argument``, separated by ``|``; NULL passes;
    * ``condition``: the SQL condition ``argument`` is false; unknown passes.
    """

    rule: str
    table_name: str
    kind: str
    column_name: str | None = None
    other_table: str | None = None
    other_column: str | None = None
    argument: str | None = None
    only_where: str | None = None

    @property
    def lookup(self) -> Lookup | None:
        """What must be known about other rows, the same for rules that can share it."""
        if self.kind == UNIQUE:
            return Lookup(self.column_name, None, None)
        if self.kind in (REFERENCES, FOREIGN_KEY, HAS_CHILD):
            return Lookup(self.column_name, self.other_table, self.other_column)
        return None


@dataclass(frozen=True, order=True)
class Lookup:
    """Is the value of ``column`` found in another table, or (without one) shared within the table?"""

    column: str
    other_table: str | None
    other_column: str | None


@dataclass(frozen=True)
class Source:
    """A table under rules: its frame and the columns that tell its rows apart, if any do."""

    frame: DataFrame
    key: tuple[str, ...] = ()


def rules_of(given: DataFrame | Iterable[Row | Mapping | Rule]) -> list[Rule]:
    """Rules from rows (a table of ``RULE_SCHEMA``, or dictionaries); missing fields are NULL. A rule table is settings,
    not data: it is read to the driver."""
    listed = given.collect() if isinstance(given, DataFrame) else list(given)
    as_dict = [r.asDict() if isinstance(r, Row) else r for r in listed]
    return [r if isinstance(r, Rule) else Rule(**{k: v for k, v in r.items() if v is not None}) for r in as_dict]


def checked(rules: list[Rule], tables: Mapping[str, Source]) -> list[Rule]:
    """The rules, if each names tables and columns that exist and what its kind needs."""
    for r in rules:
        wanted = [(r.table_name, None if r.kind == CONDITION else r.column_name)]
        if r.kind in (REFERENCES, FOREIGN_KEY, HAS_CHILD):
            wanted.append((r.other_table, r.other_column))
        if r.kind not in KINDS:
            raise RuleError(f"{r.rule}: unknown kind {r.kind!r}")
        if r.kind in (DOMAIN, CONDITION) and not r.argument:
            raise RuleError(f"{r.rule}: {r.kind} needs an argument")
        for table, column in wanted:
            if table not in tables:
                raise RuleError(f"{r.rule}: no table {table!r}")
            if (column is not None or r.kind != CONDITION) and column not in tables[table].frame.columns:
                raise RuleError(f"{r.rule}: {table} has no column {column!r}")
    names = [r.rule for r in rules]
    if len(set(names)) < len(names):
        raise RuleError("two rules have the same name")
    return rules


def _applies(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.only_where), F.lit(False)) if rule.only_where else F.lit(True)


def _own_fault(rule: Rule) -> Column | None:
    """Whether a row breaks a rule that needs no other row."""
    if rule.kind == NOT_NULL:
        return F.col(rule.column_name).isNull()
    if rule.kind == DOMAIN:
        return F.coalesce(~F.col(rule.column_name).cast("string").isin(rule.argument.split("|")), F.lit(False))
    if rule.kind == CONDITION:
        return F.coalesce(~F.expr(rule.argument), F.lit(False))
    return None


def _broken(rule: Rule, found: Column) -> Column:
    """Whether a row breaks a rule, given the answer of its lookup."""
    if rule.kind == UNIQUE:
        return found
    if rule.kind == FOREIGN_KEY:
        return ~found & F.col(rule.column_name).isNotNull()
    return ~found


def _mask(bits: list[tuple[int, Column]]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b),
                  [F.when(broken, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, broken in bits],
                  F.lit(0).cast("long"))


def _answers(source: Source, tables: Mapping[str, Source], lookup: Lookup) -> DataFrame:
    """The lookup's keys, each once: those in the other table, or those that several rows share."""
    if lookup.other_table is None:
        return (source.frame.where(F.col(lookup.column).isNotNull()).groupBy(F.col(lookup.column).alias("_answer"))
                .agg(rows().alias("_n")).where("_n > 1").select("_answer"))
    return key_set(tables[lookup.other_table].frame, lookup.other_column, "_answer")


def _in_order(lookups: Iterable[Lookup], key: tuple[str, ...]) -> list[Lookup]:
    """Lookups by the table's own key first, since that has no hot values; foreign keys, then uniqueness, last."""
    return sorted(lookups, key=lambda x: ((x.column,) != key, x.other_table is None, x.column, str(x.other_table),
                                          str(x.other_column)))


def _looked_up(tables: Mapping[str, Source], source: Source, lookups: list[Lookup],
               policy: SkewPolicy | None) -> tuple[DataFrame, dict[Lookup, Column]]:
    """The table's rows with one more column for each lookup, and those columns."""
    wide, found = source.frame, {}
    for k, lookup in enumerate(lookups):
        hot = NO_HOT_KEYS
        if (lookup.column,) != source.key:
            hot = hot_keys(source.frame, lookup.column, policy or SkewPolicy())
        wide = resolve(wide, _answers(source, tables, lookup), lookup.column, "_answer", found=f"_found{k}",
                       spread_by=list(source.key) or [lookup.column], hot=hot, unique_parent=True)
        found[lookup] = F.col(f"_found{k}")
    return wide, found


def masks(tables: Mapping[str, Source], table: str, rules: list[Rule], policy: SkewPolicy | None = None) -> DataFrame:
    """(mask, n): the table's rows counted by which of its rules they break, the first rule being the lowest bit."""
    source = tables[table]
    if len(rules) > 62:
        raise RuleError(f"{table}: more than 62 rules")
    lookups = _in_order({r.lookup for r in rules if r.lookup}, source.key)
    wide, found = _looked_up(tables, source, lookups[:-1], policy)
    last = lookups[-1] if lookups else None
    sure, when_found, when_not = [], [], []
    for k, rule in enumerate(rules):
        fault = _own_fault(rule)
        if fault is not None:
            sure.append((k, _applies(rule) & fault))
        elif rule.lookup != last:
            sure.append((k, _applies(rule) & _broken(rule, found[rule.lookup])))
        else:
            when_found.append((k, _applies(rule) & _broken(rule, F.lit(True))))
            when_not.append((k, _applies(rule) & _broken(rule, F.lit(False))))
    columns = [_mask(sure).alias("mask")]
    if last is None:
        return wide.select(*columns).groupBy("mask").agg(rows().alias("n"))
    columns += [F.col(last.column).alias("_key"), _mask(when_found).alias("_found"), _mask(when_not).alias("_not")]
    by_key = wide.select(*columns).groupBy("_key", "mask", "_found", "_not").agg(rows().alias("n"))
    if last.other_table is None:
        # A key's rows under different masks are a few entries, not rows of the table.
        whole = by_key.groupBy("_key").agg(F.sum("n").alias("_rows"),
                                           F.collect_list(F.struct("mask", "_found", "_not", "n")).alias("_parts"))
        met = whole.select((F.col("_key").isNotNull() & (F.col("_rows") > 1)).alias("_met"), F.inline("_parts"))
    else:
        keys = _answers(source, tables, last)
        met = (by_key.join(keys, F.col("_key") == F.col("_answer"), "left")
               .withColumn("_met", F.col("_answer").isNotNull()))
    either = F.when(F.col("_met"), F.col("_found")).otherwise(F.col("_not"))
    return met.select(F.col("mask").bitwiseOR(either).alias("mask"), "n").groupBy("mask").agg(F.sum("n").alias("n"))


def _by_table(rules: list[Rule]) -> dict[str, list[Rule]]:
    by = {}
    for r in rules:
        by.setdefault(r.table_name, []).append(r)
    return by


def counts(tables: Mapping[str, Source], given: DataFrame | Iterable, policy: SkewPolicy | None = None) -> DataFrame:
    """table_name, total, bad, and ``broken``: an array of (rule, kind, n) in the order the rules were given.

    One row for each table that has rules, empty tables included.
    """
    rules = checked(rules_of(given), tables)
    zero = F.lit(0).cast("long")
    parts = []
    for table, own in _by_table(rules).items():
        counted = masks(tables, table, own, policy)
        broken = [F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.col("n"))), zero)
                  for k in range(len(own))]
        parts.append(counted.agg(
            F.coalesce(F.sum("n"), zero).alias("total"),
            F.coalesce(F.sum(F.when(F.col("mask") != 0, F.col("n"))), zero).alias("bad"),
            F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.kind).alias("kind"), n.alias("n"))
                      for r, n in zip(own, broken, strict=True)]).alias("broken"))
            .select(F.lit(table).alias("table_name"), "total", "bad", "broken"))
    return reduce(DataFrame.unionByName, parts)


def quality_score(tables: Mapping[str, Source], given: DataFrame | Iterable,
                  policy: SkewPolicy | None = None) -> DataFrame:
    """table_name, total, bad, pct, score: the scorecard under the given rules. Empty tables: 0, 0, NULL, NULL."""
    bad, total = F.col("bad"), F.col("total")
    return counts(tables, given, policy).select("table_name", "total", "bad", percent(bad, total).alias("pct"),
                                                score(bad, total).alias("score"))


def rule_counts(tables: Mapping[str, Source], given: DataFrame | Iterable,
                policy: SkewPolicy | None = None) -> DataFrame:
    """table_name, rule, kind, n, pct: how many of a table's rows break each rule."""
    each = counts(tables, given, policy).select("table_name", "total", F.inline("broken"))
    return each.select("table_name", "rule", "kind", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def rule_violations(tables: Mapping[str, Source], given: DataFrame | Iterable, table: str,
                    policy: SkewPolicy | None = None) -> DataFrame:
    """The rows of one table that break a rule, plus ``broken_rules``: the names of those they break, in rule order."""
    own = _by_table(checked(rules_of(given), tables)).get(table, [])
    source = tables[table]
    wide, found = _looked_up(tables, source, _in_order({r.lookup for r in own if r.lookup}, source.key), policy)
    names = [F.when(_applies(r) & (_own_fault(r) if r.lookup is None else _broken(r, found[r.lookup])), F.lit(r.rule))
             for r in own]
    broken = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return (wide.select(*source.frame.columns, broken.alias("broken_rules"))
            .where(F.size("broken_rules") > 0))
