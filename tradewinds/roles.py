"""Column roles: any header/item table becomes the engine's item table by a mapping."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Expressions (SQL text) of the canonical item columns over a source table."""

    date: str
    decl: str
    item: str
    item_value: str
    header_value: str
    qty: str
    product: str
    chapter: str
    partner: str
    trader: str
    segment: str
    pseudo: str = "false"
    extra: dict[str, str] = field(default_factory=dict)


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")


def items(source: DataFrame, roles: Roles) -> DataFrame:
    """The item table: period ('yyyy-MM'), t (months), and the roles' columns."""
    names = [f.name for f in fields(Roles) if f.name not in ("date", "extra")]
    date = F.expr(roles.date)
    cols = [F.date_format(date, "yyyy-MM").alias("period"), month_index(date).alias("t")]
    cols += [F.expr(getattr(roles, n)).alias(n) for n in names] + [F.expr(e).alias(n) for n, e in roles.extra.items()]
    return source.select(*cols)
