"""Searches over what the scan has walked through: the best text, the first value, the first entity of some keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_text(*keys: str) -> Column:
    """The best scored text of the application data under one of the keys; the first of equal ones.

    Texts of one sign and texts of digits don't count.
    """
    fit = F.filter("walk", lambda w: w.key.isin(*[k.lower() for k in keys]) & (F.length(w.text) >= 2) & ~w.text.rlike("^[0-9]+$"))
    return _best(F.transform(fit, lambda w, i: F.struct(w.score.alias("score"), (-i).alias("at"), w.text.alias("text"))))


def best_link(*keys: str) -> Column:
    """(text, resolved) of the best text under one of the keys."""
    fit = F.filter("walk", lambda w: w.key.isin(*[k.lower() for k in keys]) & (F.length(w.text) >= 2) & ~w.text.rlike("^[0-9]+$"))
    best = F.array_max(F.transform(fit, lambda w, i: F.struct(w.score.alias("score"), (-i).alias("at"), w.text.alias("text"), w.resolved.alias("resolved"))))
    return F.when(best.isNotNull(), F.struct(best.text.alias("text"), best.resolved.alias("resolved")))


def best_site_text(keys: tuple[str, ...], sources: tuple[str, ...] = ()) -> Column:
    """The same by the sites' rules: keys may stand at the end of a longer one, records and lists have texts, any text counts."""
    ends = lambda w: _any([F.endswith(w.key, F.lit(k.lower())) for k in keys])
    fit = F.filter("walk", lambda w: ends(w) & w.site_text.isNotNull() & (w.source.isin(*sources) if sources else F.lit(True)))
    return _best(F.transform(fit, lambda w, i: F.struct(w.site_score.alias("score"), (-i).alias("at"), w.site_text.alias("text"))))


def best_of(*texts: Column) -> Column:
    """The best of some texts by the sites' rules."""
    from metaloom.functions.js import squashed, units

    def one(x: Column, i: Column) -> Column:
        score = F.least(x.n, F.lit(180)) + F.when(x.n.between(10, 140), 60).otherwise(0) - F.when(x.plain.rlike("(?i)^(home|login|index|untitled)$"), 100).otherwise(0)
        return F.struct(score.alias("score"), (-i).alias("at"), x.plain.alias("text"))

    # Each step is bound by transform(), so a text is squashed and measured once.
    plain = F.filter(F.transform(F.array(*texts), squashed), lambda t: t.isNotNull())
    return _best(F.transform(F.transform(plain, lambda t: F.struct(t.alias("plain"), units(t).alias("n"))), one))


def _best(scored: Column) -> Column:
    return F.array_max(scored).text


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def first_list(*keys: str) -> Column:
    return F.get(F.filter("walk", lambda w: w.key.isin(*keys)), 0)["list"]


def first_entity(*keys: str) -> Column:
    """The first entity with a name whose key contains one of the words."""
    has = lambda w: _any([F.contains(w.key, F.lit(k)) for k in keys])
    return F.get(F.filter("walk", lambda w: has(w) & w.entity.isNotNull() & w.entity["name"].isNotNull()), 0).entity


def node_of(*types: str) -> Column:
    """The first linked-data node with a type that ends with one of the names."""
    return F.get(F.filter("jsonld", lambda n: _typed(n, types)), 0)


def _typed(n: Column, types: tuple[str, ...]) -> Column:
    return F.exists(n.types, lambda t: _any([F.endswith(F.lower(t), F.lit(x.lower())) for x in types]))


def has_node(*types: str) -> Column:
    return F.exists("jsonld", lambda n: _typed(n, types))
