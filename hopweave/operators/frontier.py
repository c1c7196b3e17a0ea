"""Breadth-first expansion of a link graph in waves, and the crawl: waves of visits that change URL states.

A wave is one plan: the frontier joined with the pages, their links extracted, normalized, filtered,
made distinct and set against all URLs seen. Every wave is written to the shared folder, so plans don't
grow and a lost executor costs one wave's tasks at most; the seen URLs are the files of all waves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions.urls import part
from hopweave.operators.links import page_links
from hopweave.operators.state import MIN_DELAY_S, RETRY_DELAY_S, RETRY_MOST, outcome, visited
from hopweave.sources.readers import answers, seeds
from hopweave.sources.storage import StateStore, cut, workspace


def expand(spark: SparkSession, first: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: str, max_depth: int) -> DataFrame:
    """(key, depth): everything reached from ``first`` in at most ``max_depth`` steps, at its least depth."""
    root = f"{workspace(spark)}/waves-{uuid.uuid4().hex}"
    first.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(f"{root}/depth=0")
    for d in range(max_depth):
        wave = spark.read.parquet(f"{root}/depth={d}")
        seen = spark.read.parquet(*[f"{root}/depth={i}" for i in range(d + 1)])
        new = step(wave, d).select(key).where(F.col(key).isNotNull()).distinct().join(seen, key, "left_anti")
        new.write.parquet(f"{root}/depth={d + 1}")
        if spark.read.parquet(f"{root}/depth={d + 1}").isEmpty():
            break
    return spark.read.option("basePath", root).parquet(root).select(key, F.col("depth").cast("int").alias("depth"))


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, src: str, dst: str, max_depth: int) -> DataFrame:
    """Depths in a graph of edges, which are written once and read by every wave."""
    held = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    return expand(spark, seeds.select(F.col(src).alias("node")), lambda w, _: w.join(held, w["node"] == held["src"]).select(F.col("dst").alias("node")), "node", max_depth)


class Controller:
    """What a crawl decides by; the defaults accept every link, visit every page once and order nothing. Columns
    named in the methods are those of the arguments."""

    def accept(self, page: Column, link: Column) -> Column:
        """Whether a link of a page is put in the frontier. Doesn't apply to seeds."""
        return F.lit(True)

    def prepare(self, url: Column) -> Column:
        """Whether a request is cancelled; its URL is then done without a fetch."""
        return F.lit(False)

    def sched(self, url: Column, depth: Column) -> Column:
        """Score of a new URL."""
        return F.lit(0)

    def resched(self, url: Column, num_visit: Column) -> Column:
        """Whether a URL visited so often is visited again."""
        return F.lit(False)

    def wanted(self, url: Column, at: Column) -> Column:
        """When it is visited again."""
        return at

    #: Seconds before a retry, retries until a URL is given up, least seconds between visits.
    retry_delay_s, retry_most, min_delay_s = RETRY_DELAY_S, RETRY_MOST, MIN_DELAY_S


class _Accepting(Controller):
    def __init__(self, accept: Callable[[Column, Column], Column]):
        self.accept = accept


def new_states(urls: DataFrame, ctrl: Controller, now: Column) -> DataFrame:
    """States of URLs (url, depth) that nothing has visited yet."""
    zero = F.lit(0)
    columns = [
        F.col("url"), part(F.col("url"), "host").alias("host"), F.col("depth"), F.lit(False).alias("done"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("timestamp").alias("last"),
        zero.alias("num_visit"), zero.alias("num_retry"), zero.alias("num_error"), now.alias("next_at"), ctrl.sched(F.col("url"), F.col("depth")).cast("int").alias("score"),
    ]
    return urls.select(*columns)


def enqueue(store: StateStore, urls: DataFrame, ctrl: Controller | None = None, now: Column | None = None) -> None:
    """Put normalized URLs that the store doesn't have at depth 0, for a crawl that resumes or runs (its next wave
    takes them up); a URL that is none is an error."""
    fresh = seeds(urls).join(store.load().select("url"), "url", "left_anti")
    store.save(new_states(fresh, ctrl or Controller(), now if now is not None else F.current_timestamp()))


def crawl(
    spark: SparkSession, pages: DataFrame, start: DataFrame | None, accept: Callable[[Column, Column], Column] | None = None, max_depth: int = 1, store: StateStore | None = None, resume: bool = False,
    ctrl: Controller | None = None, waves: int | None = None, wave_size: int | None = None, began: str = "2024-01-01 00:00:00",
) -> DataFrame:
    """States (URL_STATE) of all URLs after a crawl of a table of pages (``readers.answers``) from ``start`` (url).

    A wave visits every unfinished URL, or the first ``wave_size`` of them by time, score and URL, each at the time
    it is due; the clock begins at ``began``. URLs without a page answer 404. Links of pages less than ``max_depth``
    deep are followed, also of pages whose handling ends in an error; a URL keeps the depth of the wave that
    found it first, the least one of that wave. A fatal error ends the run. The states change as
    ``state.visited`` says.

    Every wave adds a version to ``store`` with the URLs it visited and found, so a crawl that stops, as after so many
    ``waves``, goes on with ``resume`` from there: the rows stored before stay, their URLs are not put again, and
    the unfinished go on with their depths, retries and times. Several steps give what one run gives."""
    ctrl = ctrl or (_Accepting(accept) if accept else Controller())
    store = store or StateStore(spark, f"{workspace(spark)}/crawl-{uuid.uuid4().hex}")
    now = F.lit(began).cast("timestamp")
    if not resume and start is None:
        raise ValueError("no seeds")
    known = cut(answers(pages))
    if start is not None:
        fresh = seeds(start)
        store.save(new_states(fresh.join(store.load().select("url"), "url", "left_anti") if store.versions() else fresh, ctrl, now))
    open_, mark, n = store.unfinished(), (store.versions() or [-1])[-1], 0
    while waves is None or n < waves:
        newer = [v for v in store.versions() if v > mark]  # of the last wave, and what was enqueued meanwhile
        for v in newer:
            open_ = open_.union(store.read(v).where("NOT done").select(*open_.columns))
        mark = max([mark, *newer])
        due = cut(open_ if wave_size is None else open_.orderBy("next_at", F.desc("score"), "url").limit(wave_size))
        if due.isEmpty():
            break
        open_ = store.read(mark).limit(0) if wave_size is None else cut(open_.join(due.select("url"), "url", "left_anti").select(*due.columns))
        n += 1
        found = due.join(known.drop("html"), due["url"] == known["key"], "left").withColumn("at", F.coalesce("next_at", now))
        answer = F.when(F.col("key").isNull(), 404).when(F.col("num_visit") + F.col("num_error") < F.col("fails"), 503).otherwise(known["status"])
        found = found.withColumn("got", F.when(ctrl.prepare(F.col("url")), F.lit(None).cast("int")).otherwise(answer))
        said = F.when(ctrl.prepare(F.col("url")), "cancelled").otherwise(outcome(F.col("got"), F.when(F.col("got").between(200, 299), F.col("error"))))
        seen = cut(found.select(*[due[c] for c in due.columns if c != "status"], F.coalesce(F.col("got"), due["status"]).alias("status"), "at", said.alias("outcome"), F.col("got").between(200, 299).alias("answered")))
        bad = seen.where("outcome = 'fatal'").select("url").first()
        if bad is not None:
            raise RuntimeError(f"fatal error at {bad.url}")
        again = ctrl.resched(F.col("url"), F.col("num_visit") + 1)
        after = visited(seen, "outcome", "at", again, ctrl.retry_delay_s, ctrl.retry_most, ctrl.min_delay_s, ctrl.wanted(F.col("url"), F.col("at"))).select(*due.columns)
        hit = known.join(seen.where(F.col("answered") & (F.col("depth") < max_depth)).select("url", "depth", "at"), F.col("key") == F.col("url")).select("url", "depth", "at", "html")
        links = page_links(hit)
        put = cut(links.where(ctrl.accept(F.col("url"), F.col("link"))).groupBy(F.col("link").alias("url")).agg((F.min("depth") + 1).alias("depth"), F.min("at").alias("at")))
        # all URLs known are scanned for those found, which are few, and not shuffled
        held = spark.read.schema("url string").parquet(*[f"{store.path}/v{v}" for v in store.versions()]).join(put.select("url"), "url", "left_semi")
        fresh = new_states(put.join(held, "url", "left_anti"), ctrl, F.col("at"))
        store.save(after.unionByName(fresh))
    return store.load()
