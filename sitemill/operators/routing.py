"""Route pages to extractors by domain."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import UserDefinedTableFunction

from sitemill.constants import PAGES
from sitemill.functions.text import page_urls, routing_host, strip
from sitemill.operators.ranking import one_per_key
from sitemill.session import materialize


def routing_keys(registry: DataFrame) -> DataFrame:
    """``extractor_id, domains`` as ``route_key, extractor_id, position``: the id, then each domain.

    An id is told from a domain by its prefix.
    """
    extractor = F.regexp_replace("extractor_id", "-", "_")
    domains = F.transform("domains", F.lower)
    keys = F.concat(F.array(F.concat(F.lit("id:"), extractor)), domains)
    return registry.select(
        extractor.alias("extractor_id"), F.posexplode(keys).alias("position", "route_key")
    )


def route(pages: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """Add ``extractor_id``: the extractor whose domain is the page's host or a parent of it.

    An URL that is an extractor id takes that one; otherwise the first entry in id and
    list order wins. Unrouted pages stay, with a null id. "Host ends with .domain" becomes
    an equality join on the host's dot suffixes, over distinct hosts only, so page bodies
    are not moved for it. The routing table is written first: with its size known, Spark
    broadcasts it to the pages when it is small and else joins by host, splitting hot hosts.
    """
    host, key = routing_host(F.col(url)), F.lower(strip(F.col(url)))
    bare = F.coalesce(key.rlike("^[a-z0-9_-]+$"), F.lit(False))
    keyed = pages.withColumns({"_host": host, "_bare": bare})

    hosts = keyed.select("_host", "_bare").distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    as_id = F.concat(F.lit("id:"), F.regexp_replace("_host", "-", "_"))
    wanted = F.when(F.col("_bare"), F.concat(F.array(as_id), suffixes)).otherwise(suffixes)
    found = hosts.select("_host", "_bare", F.explode(wanted).alias("route_key")).join(
        routing_keys(registry), "route_key"
    )
    # Position 0 is an id; domains rank by extractor, then list position.
    order = [F.col("position") > 0, F.col("extractor_id"), F.col("position")]
    table = one_per_key(found, ["_host", "_bare"], order).select("_host", "_bare", "extractor_id")
    table = materialize(table, "routes")
    return keyed.join(table, ["_host", "_bare"], "left").drop("_host", "_bare")


def extractor_page_urls(routed: DataFrame, max_pages: Column, pagers: dict[str, Callable[[Column, Column], Column]], url: str = "url", extractor: str = "extractor_id") -> DataFrame:
    """Adds ``page_urls``: those of the row's extractor, or the generic ``?page=`` form without one.

    ``pagers`` maps extractor ids to column functions of (base URL, number of pages).
    """
    found = page_urls(F.col(url), max_pages)
    for name, pager in pagers.items():
        found = F.when(F.col(extractor) == name, pager(F.col(url), max_pages)).otherwise(found)
    return routed.withColumn("page_urls", found)


def page_table(pagers: dict[str, Callable[[str, int], Iterable[str]]]) -> UserDefinedTableFunction:
    """A table function of (extractor id, base URL, number of pages) that gives ``pos, page_url`` as the extractor's own Python code pages.

    The code may do what no column expression can: follow what it made itself, keep a state, stop when it likes.
    Nothing for extractors without code of their own and for null URLs; a null or non-positive number counts as ``PAGES``.
    """

    class Pages:
        def eval(self, extractor_id: str, base: str, pages: int):
            pager = pagers.get(extractor_id)
            if pager is not None and base is not None:
                yield from enumerate(pager(base, pages if pages and pages > 0 else PAGES))

    return udtf(Pages, returnType="pos int, page_url string", useArrow=True)


def page_rows(
    routed: DataFrame,
    max_pages: Column,
    pagers: dict[str, Callable[[Column, Column], Column]],
    coded: dict[str, Callable[[str, int], Iterable[str]]],
    url: str = "url",
    extractor: str = "extractor_id",
) -> DataFrame:
    """A row per page: ``pos`` (from 0) and ``page_url``. Extractors in ``coded`` page by Python code, the others as in ``extractor_page_urls``.

    Only rows of coded extractors go through Python.
    """
    own = F.coalesce(F.col(extractor).isin(list(coded)), F.lit(False))
    plain = extractor_page_urls(routed.where(~own), max_pages, pagers, url, extractor)
    rows = plain.select(*routed.columns, F.posexplode("page_urls").alias("pos", "page_url"))
    if not coded:
        return rows
    called = routed.where(own).withColumn("_pages", max_pages.cast("int"))
    paged = called.lateralJoin(page_table(coded)(F.col(extractor).outer(), F.col(url).outer(), F.col("_pages").outer()))
    return rows.unionByName(paged.drop("_pages"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
