"""Whom to contact when: owners for items and a daily plan within capacities."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ravelin.operators.history import history_features, top_share


@dataclass(frozen=True)
class PlanSettings:
    """Contacts that a member makes a day, least days between two contacts of an item, and the days to plan."""

    capacity: int = 8
    gap: int = 14
    start: date = date(2024, 2, 1)
    days: int = 28
    workdays_only: bool = True

    def calendar(self) -> list[date]:
        all_ = [self.start + timedelta(days=i) for i in range(self.days)]
        return [d for d in all_ if d.weekday() < 5] if self.workdays_only else all_


def default_settings(history: DataFrame, member: str, item: str, time: str) -> DataFrame:
    """(capacity, gap): the median number of contacts of a member's day, and the median gap between contacts of an item."""
    day = F.to_date(time)
    load = history.groupBy(member, day.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.median("n").alias("capacity"))
    gap = history.withColumn("_g", F.datediff(day, F.lag(day).over(W.partitionBy(item).orderBy(time)))).agg(F.median("_g").alias("gap"))
    return load.crossJoin(F.broadcast(gap))  # one row each


def assign_owners(items: DataFrame, history: DataFrame, item: str, member: str, group: str | None = None) -> DataFrame:
    """(item, owner): each item to the member with most contacts to it, within equal quotas; others where there is room.

    Groups are independent and go to tasks of their own: inside one, the choice is a sequence. An item's own strengths are
    counted in Spark before; only (item, member, contacts) reach the choice.
    """
    by = F.col(group) if group else F.lit("all")
    strength = history.groupBy(by.alias("_group"), item, member).agg(F.count(F.lit(1)).alias("n"))
    both = items.select(by.alias("_group") if group and group in items.columns else F.lit("all").alias("_group"), item).distinct()
    d = both.join(strength, ["_group", item], "left") if group and group in items.columns else both.drop("_group").join(strength, item, "left").withColumn("_group", F.lit("all"))
    kind, owner_kind = dict(items.dtypes)[item], dict(history.dtypes)[member]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(pdf[member].dropna().unique())
        names = sorted(pdf[item].unique())
        if not members:
            return pd.DataFrame({item: [], "owner": []})
        quota = -(-len(names) // len(members))
        load = dict.fromkeys(members, 0)
        past: dict = {}
        for i, m, n in pdf[[item, member, "n"]].dropna().itertuples(index=False):
            past.setdefault(i, {})[m] = n
        out = {}
        for i in sorted(names, key=lambda x: (-max(past.get(x, {0: 0}).values()), x)):
            free = [m for m in members if load[m] < quota]
            m = min(free, key=lambda x: (-past.get(i, {}).get(x, 0), load[x], x))
            load[m] += 1
            out[i] = m
        return pd.DataFrame({item: list(out), "owner": list(out.values())})

    return d.groupBy("_group").applyInPandas(run, f"{item} {kind}, owner {owner_kind}")


def daily_plan(scored: DataFrame, item: str, owner: str, settings: PlanSettings, last: str | None = None) -> DataFrame:
    """(owner, day, position, item, score): each owner's contacts by day: best score first, gaps kept, days evenly filled.

    ``scored`` has item, owner, score and optionally the date of the last contact. Owners are planned independently.
    """
    days, capacity, gap = settings.calendar(), settings.capacity, settings.gap
    kinds = dict(scored.dtypes)
    columns = [item, owner, "score", *([last] if last else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", item], ascending=[False, True])
        span = (days[-1] - days[0]).days + 1 if days else 0
        level = min(capacity, max(1, -(-len(pdf) * -(-span // gap) // max(1, len(days)))))
        due = {i: (pd.Timestamp(t).date() + timedelta(days=gap)) if last and not pd.isna(t) else days[0] for i, t in zip(pdf[item], pdf[last] if last else pdf[item], strict=True)} if days else {}
        rows = []
        for d in days:
            ready = [(i, s) for i, s in zip(pdf[item], pdf["score"], strict=True) if due[i] <= d][:level]
            for k, (i, s) in enumerate(ready, 1):
                rows.append((pdf[owner].iloc[0], d, k, i, s))
                due[i] = d + timedelta(days=gap)
        return pd.DataFrame(rows, columns=[owner, "day", "position", item, "score"])

    return scored.select(*columns).groupBy(owner).applyInPandas(run, f"{owner} {kinds[owner]}, day date, position int, {item} {kinds[item]}, score double")


def plan_summary(plan: DataFrame, owner: str) -> DataFrame:
    """(owner, days, contacts, per_day)."""
    return plan.groupBy(owner).agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("contacts")).withColumn("per_day", F.col("contacts") / F.col("days"))


def backtest(history: DataFrame, item: str, time: str, row_id: str, success, share: float = 0.2) -> DataFrame:
    """(rule, contacts, success_rate): what the best ``share`` of each week's contacts by simple rules would have come to.

    Rules: overdue (longest without contact), past rate, chance (a hash), and all contacts. Each uses history before the contact.
    """
    d = history_features(history, item, time, row_id, success).withColumn("_y", F.coalesce(success, F.lit(False)).cast("int"))
    week = F.date_trunc("week", time)
    rules = {
        "overdue": F.coalesce(F.col("days_since_last"), F.lit(10**6)).cast("double"),
        "past rate": F.coalesce("prior_success_rate", F.lit(-1.0)),
        "chance": F.xxhash64(row_id, F.lit("chance")).cast("double"),
    }
    out = d.agg(F.lit("all").alias("rule"), F.count(F.lit(1)).alias("contacts"), F.avg("_y").alias("success_rate"))
    for name, score in rules.items():
        best = top_share(d.withColumn("_score", score), week, "_score", row_id, share)
        out = out.unionByName(best.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("contacts"), F.avg("_y").alias("success_rate")))
    return out


def detect_roles(df: DataFrame, schema) -> dict[str, str | None]:
    """item, member, time and outcome columns of an interaction table: repeated keys by how many they are; 2 to 20 outcomes."""
    rows = max(1, schema.rows)
    keys = sorted((c for c in schema.columns if c.role in ("identifier", "dimension") and 1 < c.n_unique < 0.5 * rows), key=lambda c: (c.role != "identifier", -c.n_unique))
    outcomes = [c for c in schema.columns if c.role in ("dimension", "binary") and 2 <= c.n_unique <= 20]
    return {"item": keys[0].name if keys else None, "member": keys[1].name if len(keys) > 1 else None, "time": schema.primary_time(), "outcome": outcomes[0].name if outcomes else None}
