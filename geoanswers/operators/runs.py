"""Analytics over the logs of processing runs: states, failures, batches, prices, items, reviews, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# They must be those of the service whose logs are read.
#: Run states by bucket; whatever else is active.
FAILED = ["failed", "cancelled"]
DONE = ["completed", "succeeded"]
REVIEW = ["needs_review", "review_required"]
#: States that end a batch, and those that end a plan's run.
TERMINAL = ["completed", "failed", "cancelled", "partial", "completed_with_failures"]
PLAN_ENDS = ["completed", "succeeded", "failed", "cancelled", "needs_review"]
#: The code of an item refused because it stands nowhere on the earth: a retry cannot help.
PLACEMENT = "GEOREFERENCE_REQUIRED"
#: Item states in order of attention, with mark, label and next action.
ITEMS = {
    "failed": ("!", "Failed", "open"),
    "needs_review": ("?", "Needs review", "review"),
    "running": ("*", "Running", ""),
    "pending": ("-", "Queued", ""),
    "succeeded": ("+", "Done", "import"),
    "cancelled": ("x", "Cancelled", ""),
}
#: Labels of step states.
STEPS = {
    "planned": "queued",
    "running": "running",
    "succeeded": "done",
    "failed": "failed",
    "skipped": "skipped",
    "refused": "declined",
    "awaiting_input": "waiting for you",
    "awaiting_confirmation": "waiting for your approval",
}
#: Verdicts by urgency; statuses of sound geometry; statuses of features that wait for a review.
BUCKETS = ["invalid", "needs_review", "clean"]
SOUND = ["valid", "ok", "passed"]
PENDING = ["needs_review", "review_required", "pending"]
TITLE, LISTED = 120, 10


def said(c: Column) -> Column:
    """Trimmed text; NULL where nothing is said."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def run_state(job_state: Column, status: Column) -> Column:
    """The job's state where there is one (a required review shows as needs_review), else the task's status; lower case,
    NULL where neither says anything."""
    job = F.lower(said(job_state))
    return F.coalesce(F.when(job == "review_required", "needs_review").otherwise(job), F.lower(said(status)))


def run_bucket(state: Column) -> Column:
    """review_required, failed (cancelled too) or completed; whatever else, unknown states too, is active."""
    known = F.when(state.isin(REVIEW), "review_required").when(state.isin(FAILED), "failed")
    return known.when(state.isin(DONE), "completed").otherwise("active")


def run_failure(message: Column, reference: Column) -> Column:
    """The message and its support reference; NULL where no message was given."""
    suffix = F.concat(F.lit(" (reference "), said(reference), F.lit(")"))
    return F.concat(said(message), F.coalesce(suffix, F.lit("")))


def failure_code(code: Column) -> Column:
    return F.upper(said(code))


def failure_guidance(failures: DataFrame, steps: DataFrame) -> DataFrame:
    """failures (run_id, code, message) with the next step of its code, where there is one, in the message's place."""
    named = failures.join(steps.select("code", "next_step"), "code", "left")
    return named.select("run_id", "code", F.coalesce("next_step", "message").alias("message"))


def run_started(state: Column, moved: Column) -> Column:
    """False while it waits unless a step has moved; NULL where the state is unknown."""
    waits = state.isin("queued", "pending", "created")
    return F.when(state.isNull(), F.lit(None).cast("boolean")).when(waits, F.coalesce(moved, F.lit(False))).otherwise(True)


def batch_terminal(state: Column) -> Column:
    return F.coalesce(F.lower(state).isin(TERMINAL), F.lit(False))


def run_counts(runs: DataFrame) -> DataFrame:
    """state, runs: over all rows; no state is "unknown"."""
    return runs.groupBy(F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("runs"))


def in_bucket(runs: DataFrame, wanted: str) -> DataFrame:
    """The runs of a bucket (all, review_required, failed, completed, active); another word matches none."""
    if wanted in ("", "all"):
        return runs
    return runs.filter(run_bucket(F.col("state")) == wanted)


def run_listing(runs: DataFrame, wanted: str = "all", limit: int = LISTED) -> DataFrame:
    """The newest runs of a bucket: run_id, state, title of at most 120 characters, error, code, and how many there are
    in the bucket (matched) and in all (total). runs: run_id, state, seq, title, message, reference, code."""
    whole = runs.agg(F.count("*").alias("total"))
    hits = in_bucket(runs, wanted)
    matched = hits.agg(F.count("*").alias("matched"))
    newest = hits.orderBy(F.desc("seq"), "run_id").limit(max(1, limit))
    error = run_failure(F.col("message"), F.col("reference"))
    listed = newest.select(
        "run_id", F.coalesce("state", F.lit("unknown")).alias("state"), F.substring(F.trim("title"), 1, TITLE).alias("title"),
        error.alias("error"), failure_code(F.col("code")).alias("code"),
    )
    return listed.crossJoin(F.broadcast(matched)).crossJoin(F.broadcast(whole))


def succeeded_runs(items: DataFrame) -> DataFrame:
    """run_id of the items that succeeded and have a run."""
    return items.filter(said(F.col("run_id")).isNotNull() & F.lower("state").isin(DONE)).select("run_id")


def review_runs(items: DataFrame) -> DataFrame:
    """run_id of the items that need a review and have a run."""
    return items.filter(said(F.col("run_id")).isNotNull() & F.lower("state").isin(REVIEW)).select("run_id")


def review_pick(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """The named run, else the newest that needs a review, else nothing."""
    if run_id is not None:
        return runs.filter(F.col("run_id") == run_id)
    return runs.filter(F.col("state").isin(REVIEW)).orderBy(F.desc("seq"), "run_id").limit(1)


def latest_review(runs: DataFrame, project: str) -> DataFrame:
    """The newest run of each project that needs a review: a combinable maximum."""
    newest = runs.filter(F.col("state").isin(REVIEW)).groupBy(project).agg(F.max(F.struct("seq", "run_id")).alias("m"))
    return newest.select(project, F.col("m.run_id").alias("run_id"), F.col("m.seq").alias("seq"))


def item_state(state: Column) -> Column:
    return F.coalesce(F.lower(F.trim(state)), F.lit(""))


def batch_summary(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, items, failed, needs_review, done."""
    s = item_state(F.col("state"))
    counted = {"failed": "failed", "needs_review": "needs_review", "done": "succeeded"}
    return items.groupBy(batch).agg(F.count("*").alias("items"), *[F.count_if(s == state).alias(name) for name, state in counted.items()])


def batch_failures(items: DataFrame, code: str = PLACEMENT, batch: str = "batch_id", unknown: bool = False) -> DataFrame:
    """batch, failed, the first typed error by index (first_index, first_code, first_message), and whether every failure
    carries the code: one without a code differs. An error without code and message is no typed error. ``unknown``: where the
    codes of all failures are NULL, it is not known whether they carry it."""
    bad = items.filter(F.lower("state") == "failed").withColumn("_code", failure_code(F.col("code"))).withColumn("_message", said(F.col("message")))
    typed = F.col("_code").isNotNull() | F.col("_message").isNotNull()
    first = F.min(F.when(typed, F.struct("index", "_code", "_message"))).alias("m")
    every = F.bool_and(F.coalesce(F.col("_code") == code, F.lit(False)))
    if unknown:
        every = F.when(F.count("code") > 0, every)
    found = bad.groupBy(batch).agg(F.count("*").alias("failed"), first, every.alias("every"))
    return found.select(batch, "failed", F.col("m.index").alias("first_index"), F.col("m._code").alias("first_code"), F.col("m._message").alias("first_message"), "every")


def price_lookup(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Items with their kind's cents; a kind without a price stays unknown."""
    return items.join(prices.select("kind", "cents"), "kind", "left")


def whole_sum(c: Column) -> Column:
    """A sum that one unknown makes unknown; zero stays zero."""
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def batch_cost(items: DataFrame, prices: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, items, sheets, unknown (items with sheets whose kind has no price), and what the sheets come to: cents, later_cents
    (charged when a placed sheet leaves, never held at the start), placements and traces. They are NULL where a price is missing
    or nothing is to be priced; a price of zero is a price. prices: kind, cents, and, each sheet, leave_cents, placements and
    traces, of which an older list may lack some (then there is none of it)."""
    sheets = F.greatest(F.coalesce("sheets", F.lit(0)), F.lit(0)).cast("long")
    extra = {"later_cents": "leave_cents", "placements": "placements", "traces": "traces"}
    listed = prices.select("kind", F.col("cents").cast("long").alias("_cents"), *[(F.coalesce(F.col(c), F.lit(0)) if c in prices.columns else F.lit(0)).cast("long").alias(f"_{n}") for n, c in extra.items()])
    priced = items.select(batch, "kind", sheets.alias("_sheets")).join(listed, "kind", "left")
    unknown = F.col("_cents").isNull() & (F.col("_sheets") > 0)
    total = priced.groupBy(batch).agg(F.count("*").alias("items"), F.sum("_sheets").alias("sheets"), F.count_if(unknown).alias("unknown"), *[F.coalesce(F.sum(F.col(f"_{n}") * F.col("_sheets")), F.lit(0)).alias(f"_{n}") for n in ("cents", *extra)])
    known = (F.col("unknown") == 0) & (F.col("sheets") > 0)
    return total.select(batch, "items", "sheets", "unknown", *[F.when(known, F.col(f"_{n}")).alias(n) for n in ("cents", *extra)])


def quote_sum(quotes: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, files, cents: each file once; one unknown makes the sum unknown."""
    once = quotes.groupBy(batch, "file_id").agg(F.min("cents").alias("cents"))
    return once.groupBy(batch).agg(F.count("*").alias("files"), whole_sum(F.col("cents")).alias("cents"))


def affordability(costs: DataFrame, balances: DataFrame, key: str) -> DataFrame:
    """key, known, enough, short: the balance against the cost."""
    both = costs.join(balances, key, "left")
    known = F.col("cents").isNotNull() & F.col("balance").isNotNull()
    short = F.greatest(F.col("cents") - F.col("balance"), F.lit(0))
    return both.select(key, known.alias("known"), F.when(known, F.col("balance") >= F.col("cents")).alias("enough"), F.when(known, short).alias("short"))


def name_lookup(items: DataFrame, files: DataFrame) -> DataFrame:
    """batch_id, index, title: the file's name without its folder, else "Item" and the position from 1; behind it the
    page of a paged file (page 0 is none)."""
    named = items.join(files.select("file_id", "name"), "file_id", "left")
    name = F.coalesce(F.nullif(F.substring_index("name", "/", -1), F.lit("")), F.concat(F.lit("Item "), (F.col("index") + 1).cast("string")))
    page = F.when(F.col("page") > 0, F.concat(F.lit(" · page "), F.col("page").cast("string"))).otherwise("")
    return named.select("batch_id", "index", F.concat(name, page).alias("title"))


def attention_order(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Items with their place in a batch: failures first, unknown states last, else as submitted."""
    s = item_state(F.col("state"))
    rank = F.coalesce(*[F.when(s == state, k) for k, state in enumerate(ITEMS)], F.lit(len(ITEMS)))
    return items.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(rank, "index")))


def review_bucket(properties: Column) -> Column:
    """invalid (a validation status that isn't sound) before needs_review (a true flag, or a status that waits) before
    clean."""
    text = lambda name: F.lower(said(properties[name]))
    invalid = ~text("validation_status").isin(SOUND)
    review = properties["review_required"].eqNullSafe(F.lit(True)) | text("review_status").isin(PENDING)
    return F.when(invalid, "invalid").when(F.coalesce(review, F.lit(False)), "needs_review").otherwise("clean")


def review_buckets(features: DataFrame) -> DataFrame:
    """bucket, features, urgency: buckets that hold something."""
    out = features.groupBy(review_bucket(F.col("properties")).alias("bucket")).agg(F.count("*").alias("features"))
    return out.withColumn("urgency", F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket")))


def plan_report(plans: DataFrame) -> DataFrame:
    """run_id, state, finished, layers from plans (run_id, job_state, status, layers): an unknown state is not finished,
    and a run shows its layers when it has finished without failing."""
    state = run_state(F.col("job_state"), F.col("status"))
    shown = state.isin([s for s in PLAN_ENDS if s not in FAILED])
    finished = F.coalesce(state.isin(PLAN_ENDS), F.lit(False))
    return plans.select("run_id", state.alias("state"), finished.alias("finished"), F.when(shown, F.coalesce("layers", F.lit(0))).otherwise(0).alias("layers"))


def item_status(items: DataFrame) -> DataFrame:
    """items (index, state, message) as index, state, mark, label, detail, action; an unheard-of state is shown as
    itself."""
    s = item_state(F.col("state"))
    words = F.regexp_replace(s, "_", " ")
    itself = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    rest = ("?", F.coalesce(F.nullif(itself, F.lit("")), F.lit("Unknown")), "")
    pick = lambda i: F.coalesce(*[F.when(s == k, v[i]) for k, v in ITEMS.items()], rest[i] if isinstance(rest[i], Column) else F.lit(rest[i]))
    return items.select("index", s.alias("state"), pick(0).alias("mark"), pick(1).alias("label"), said(F.col("message")).alias("detail"), pick(2).alias("action"))


def _tenths(s: Column) -> Column:
    """Tenths of a number, to the nearest; halves by the number as it is stored, exact ones to even, as printf rounds it.
    format_string rounds the shortest decimal text instead."""
    down = F.floor(s * 10).cast("long")
    half = (2 * down + 1).cast("double")
    over = (s * 16 - half) + s * 4  # the sign of s - half / 20: both steps are exact
    return down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)


def duration_text(ms: Column, printf: bool = False) -> Column:
    """Milliseconds below a second, seconds above it; NULL where nothing was measured. Halves of the decimal text go up;
    ``printf``: they go as printf rounds the number as it is stored, exact halves to even."""
    s = ms / 1000.0
    if printf:
        tenths = _tenths(s)
        short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" s"))
        whole = F.concat(F.bround(s, 0).cast("decimal(38,0)").cast("string"), F.lit(" s"))
    else:
        short, whole = F.format_string("%.1f s", s), F.format_string("%.0f s", s)
    long = F.when(s < 10, short).otherwise(whole)
    return F.when(ms <= 0, F.lit(None)).when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(long)


def trace_steps(turns: DataFrame, printf: bool = False) -> DataFrame:
    """turn_id, position, title, status, label, duration, detail, code from steps (struct(index, title, capability,
    status, duration_ms, message, error_code, error_message)): no index or 0 is the place, no status is succeeded, no
    title the capability, no message the error's. ``printf``: how durations are rounded."""
    rows = turns.select("turn_id", F.posexplode("steps").alias("i", "s"))
    status = F.coalesce(F.nullif(F.col("s.status"), F.lit("")), F.lit("succeeded"))
    label = F.coalesce(*[F.when(status == k, v) for k, v in STEPS.items()], status)
    return rows.select(
        "turn_id", F.coalesce(F.nullif("s.index", F.lit(0)), F.col("i") + 1).alias("position"),
        F.coalesce(said(F.col("s.title")), said(F.col("s.capability")), F.lit("Step")).alias("title"), status.alias("status"), label.alias("label"),
        duration_text(F.col("s.duration_ms"), printf).alias("duration"), F.coalesce(said(F.col("s.message")), said(F.col("s.error_message"))).alias("detail"),
        said(F.col("s.error_code")).alias("code"),
    )


def budget_stops(turns: DataFrame) -> DataFrame:
    """Turns that ended because their steps ran out."""
    return turns.filter(F.col("budget.exhausted").eqNullSafe(True)).select("turn_id", F.col("budget.used").alias("used"), F.col("budget.allowed").alias("allowed"))


def source_summary(sources: DataFrame, kind: Column, task: str = "task_id", most: int = 12) -> DataFrame:
    """task, files, layers, bytes, wrong, wrong_sources, more_wrong: files and layers counted apart, and the sources that the
    task's workflow (wanted: vector or raster) cannot read, each by name in order (the first ``most`` of them; more_wrong says
    how many are not named). sources: task, origin (file or layer), label, bytes, wanted; kind: what a source holds."""
    known = sources.withColumn("_wrong", F.coalesce(kind != F.col("wanted"), F.lit(True)))
    counts = known.groupBy(task).agg(
        F.count_if(F.col("origin") == "file").alias("files"), F.count_if(F.col("origin") == "layer").alias("layers"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if("_wrong").alias("wrong"),
    )
    # the limit on places is taken over before the shuffle, so a task with very many wrong sources sends few
    place = F.row_number().over(Window.partitionBy(task).orderBy(F.col("label").asc_nulls_last()))
    first = known.filter("_wrong").select(task, "label").withColumn("_place", place).filter(F.col("_place") <= most)
    named = first.groupBy(F.col(task).alias("_task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "label"))), lambda x: x["label"]).alias("_named"))
    both = counts.join(named, F.col(task).eqNullSafe(F.col("_task")), "left")
    more = F.greatest(F.col("wrong") - most, F.lit(0)).alias("more_wrong")
    return both.select(task, "files", "layers", "bytes", "wrong", F.coalesce("_named", F.array().cast("array<string>")).alias("wrong_sources"), more)
