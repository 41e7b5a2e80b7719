"""Jobs from stored pages to catalogue tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import merge_maps
from ..operators import extract as E, merge as M, validate as V
from ..session import cut_lineage, written
from ..sources.exports import Snapshots


@dataclass
class Ingested:
    """Rows to merge, rows refused with their errors, and pages (page_id, url, parse_error) that can't be parsed."""
    rows: DataFrame
    refused: DataFrame
    broken: DataFrame


def ingest_navigation(pages: DataFrame, selectors: list[str] = E.NAVIGATION_SELECTORS) -> Ingested:
    """Menu links of all pages as navigation rows, one per url: that of the newest page, and on it the first."""
    parsed = E.parse_pages(E.with_recency(pages), selectors)
    found = E.newest(parsed.select("page_id", "url", "parse_error", E.menu(selectors).alias("menu"), *E.RECENCY), "menu-links")
    links = E.catalogue_links(found)
    rows = M.latest_per_key(links.select("source_url", "title", "page_id", "position")
                            .withColumns({"_p": F.col("page_id"), "_n": -F.col("position")}), "source_url", ["_p", "_n"])
    good, bad = V.split_valid(rows.select("title", "source_url", F.lit(None).cast("string").alias("parent_id")),
                              V.rules("write_navigation"))
    return Ingested(good, bad, broken_pages(found))


def broken_pages(found: DataFrame) -> DataFrame:
    return found.filter(F.col("parse_error").isNotNull()).select("page_id", "url", "parse_error")


def chain_heads(facts: DataFrame) -> DataFrame:
    """url -> category_url: the first page of the chain of next links a page belongs to.

    Pointers double their reach each round, so a chain of n pages takes log2(n) joins.  Pages on a
    loop of next links have no first page; each of them stands for itself.  There is one pointer per
    url, however often the url occurs, so no round makes more rows.
    """
    facts = facts.filter(F.col("url").isNotNull()).groupBy("url").agg(F.max("next_url").alias("next_url"))
    previous = (facts.filter(F.col("next_url").isNotNull()).groupBy(F.col("next_url").alias("url"))
                .agg(F.min("url").alias("_previous")))
    pointers = cut_lineage(facts.select("url").join(previous, "url", "left").select(
        "url", F.coalesce("_previous", "url").alias("head"), F.col("_previous").isNull().alias("done")))
    rounds = pointers.count().bit_length()
    while rounds > 0 and not pointers.filter("not done").isEmpty():
        step = pointers.select(F.col("url").alias("head"), F.col("head").alias("_far"), F.col("done").alias("_done"))
        pointers = cut_lineage(pointers.join(step, "head", "left").select(
            "url", F.coalesce("_far", "head").alias("head"), F.coalesce("_done", F.lit(True)).alias("done")))
        rounds -= 1
    return pointers.select("url", F.when(F.col("done"), F.col("head")).otherwise(F.col("url")).alias("category_url"))


def ingest_category(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category rows (title, source_url, product_count), listing rows with their category_url, broken pages.

    Of a page that was crawled several times the newest row counts.  Each page is parsed once: its facts, links and
    cards are written, and the branches read those.
    """
    parsed = E.with_category_links(E.with_cards(E.with_page_facts(E.parse_pages(E.with_recency(pages)))))
    facts = parsed.select("page_id", "url", "parse_error", "page_title", "next_url", "cards",
                          F.get("links", F.lit(0))["title"].alias("_first"), *E.RECENCY)
    everything = written(E.newest(facts, "category-crawls"), "category-pages")
    found = everything.filter(F.col("parse_error").isNull())
    heads = chain_heads(found.select("url", "next_url"))
    placed = found.join(heads, "url")
    # Sizes are added up per page, so a long chain moves one number per page.
    sizes = placed.groupBy("category_url").agg(F.sum(F.size("cards")).cast("int").alias("product_count"))
    categories = (found.select(F.col("url").alias("category_url"), "page_title", "_first").join(sizes, "category_url")
                  .select(F.coalesce("_first", F.nullif("page_title", F.lit("")), F.lit("Unknown Category")).alias("title"),
                          F.col("category_url").alias("source_url"), "product_count"))
    return categories, placed.select("page_id", "url", "category_url", F.inline("cards")), broken_pages(everything)


def listing_products(chained: DataFrame, categories: DataFrame) -> DataFrame:
    """Listing rows as product rows of their category (for a fill-only merge)."""
    return M.attach_category(chained, categories).select(
        "title", F.col("product_url").alias("source_url"), "price", "currency",
        F.when(F.col("thumbnail") != "", F.array("thumbnail")).alias("image_urls"), "category_id",
        F.col("url").alias("page_url"), "position")


def ingest_products(pages: DataFrame, strict: bool = False, source_id_pattern: str = r"/product/([^/]+)") -> Ingested:
    """Product rows of detail pages.  A page without title is refused; with `strict` it fails the job.

    The extracted facts are written once, so that neither the check nor its two outputs parse again.
    """
    parsed = E.parse_pages(E.with_recency(pages))
    everything = written(E.newest(E.product_details(parsed, source_id_pattern, E.RECENCY), "product-crawls", "source_url"), "product-pages")
    details = everything.filter(F.col("parse_error").isNull()).drop("parse_error")
    rows = details.withColumn("currency", F.coalesce("currency", F.lit("GBP"))).withColumn(
        "category_id", F.lit(None).cast("string"))
    rules = V.rules("write_product")
    broken = broken_pages(everything.withColumnRenamed("source_url", "url"))
    if strict:
        whole = everything.withColumn("title", F.when(F.col("parse_error").isNull(), F.col("title"))).select(*details.columns)
        checked = whole.withColumn("currency", F.coalesce("currency", F.lit("GBP"))).withColumn(
            "category_id", F.lit(None).cast("string"))
        return Ingested(V.require_valid(checked, rules), V.with_errors(rows.limit(0), rules), broken)
    good, bad = V.split_valid(rows, rules)
    return Ingested(good, bad, broken)


def process_jobs(jobs: DataFrame, processor: Callable, schema: str) -> DataFrame:
    """Run a user's function over batches of job rows on the executors."""
    return jobs.mapInPandas(processor, schema)


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """Count while the rows flow: the measures are ready after the one action that uses the frame."""
    seen = Observation(name)
    measures = measures or {"rows": F.count(F.lit(1))}
    return df.observe(seen, *[c.alias(n) for n, c in measures.items()]), seen


def run_account(pages: DataFrame, got: Ingested) -> DataFrame:
    """One row for a run: pages requested, crawled (the newest of each url), successful, refused and broken, and the share
    of the crawled that were successful (null without any)."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return (pages.agg(F.count(F.lit(1)).alias("requested"))
            .withColumns({"successful": count(got.rows), "refused": count(got.refused), "broken": count(got.broken)})
            .withColumn("crawled", F.col("successful") + F.col("refused") + F.col("broken"))
            .withColumn("success_rate", F.round(F.try_divide(F.col("successful"), F.col("crawled")), 6)))


Stage = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


@dataclass
class JobMark:
    """The job that a composite write belongs to: the name of the table of jobs among the stores, its id, the moment."""
    table: str
    job_id: str
    as_of: Column


def _marked(jobs: DataFrame, mark: JobMark, status: str, rows: dict[str, int], error: str | None) -> DataFrame:
    """The jobs with one of them ended: its lock is gone, its metadata has the rows written per table."""
    mine = F.col("id") == mark.job_id
    counts = [F.lit(x) for name, n in rows.items() for x in (f"rows_{name}", str(n))]
    changed = {
        "status": F.lit(status), "completed_at": mark.as_of, "updated_at": mark.as_of, "locked_at": F.lit(None), "locked_by": F.lit(None),
        "last_error": F.lit(error), "metadata": merge_maps(F.col("metadata"), F.create_map(*counts)) if counts else F.col("metadata")}
    kinds = {f.name: f.dataType for f in jobs.schema}
    return jobs.withColumns({c: F.when(mine, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in changed.items() if c in kinds})


def publish_all(stores: dict[str, Snapshots], commits: Snapshots, stages: list[Stage], version: int,
                job: JobMark | None = None) -> dict[str, int]:
    """Run the stages in order and publish every table they return, or none.

    Each returned table is written once, as a snapshot of this version, and later stages read it from
    there.  Readers follow the commit, one small row per table that names its snapshot; it is written
    last, so an error in any stage leaves them on the old state.  Returns the rows written per table.

    With a job, its mark is part of the same commit: completed, with the rows per table.  If a stage fails, a commit of
    this version has the old state of all other tables and the job as failed, with the error and the rows written so far.
    """
    spark = commits.spark
    old = committed_versions(stores, commits)
    versions, state, rows = dict(old), {name: stores[name].at(v) for name, v in old.items()}, {}

    def publish(name: str, table: DataFrame) -> None:
        counted, seen = observed(table, f"{name}-{version}")
        stores[name].publish(counted, version)
        rows[name], versions[name] = seen.get["rows"], version
        state[name] = stores[name].at(version)

    def commit(named: dict[str, int]) -> None:
        commits.publish(spark.createDataFrame(list(named.items()), "name string, version bigint").coalesce(1), version)

    try:
        for stage in stages:
            for name, table in stage(dict(state)).items():
                publish(name, table)
    except Exception as error:
        if job:
            stores[job.table].publish(_marked(stores[job.table].at(old[job.table]), job, "failed", rows, str(error)[:500]), version)
            commit(old | {job.table: version})
        raise
    if job:
        marked = _marked(state[job.table], job, "completed", dict(rows), None)
        # A table of jobs that a stage has written is read while its mark is: it goes through a folder of its own.
        stores[job.table].publish(written(marked, "job-mark") if versions[job.table] == version else marked, version)
        versions[job.table] = version
    commit(versions)
    return rows


def committed_versions(stores: dict[str, Snapshots], commits: Snapshots) -> dict[str, int]:
    """Snapshot per table of the last commit; before the first one, the newest of each table."""
    last = commits.read()
    if last is not None:
        return {row["name"]: row["version"] for row in last.collect()}
    return {name: store.versions()[-1] for name, store in stores.items() if store.versions()}


def read_published(stores: dict[str, Snapshots], commits: Snapshots) -> dict[str, DataFrame]:
    return {name: stores[name].at(v) for name, v in committed_versions(stores, commits).items()}
