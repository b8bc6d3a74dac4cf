"""Streams: reading sessions, activity segments, stitched transcripts, upserts and publication.

Streams keep state with applyInPandasWithState; state of a key that is silent for `idle_ms` is dropped.  Batches find by windows where
a key's rows divide into parts that do not touch each other, and gather at most such a part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from readlake.sources.tables import BucketedTable

DAY_MS = 24 * 3600 * 1000


def track_reading_batch(updates: DataFrame, keys: tuple[str, ...] = ("reader", "book")) -> DataFrame:
    """Tracked time and characters of each (key, day) from updates (ts, event start | update | pause, position), without a UDF.

    Time runs while tracking: from a start to the next pause.  An update in the same millisecond as the one before is ignored.  A backward
    jump takes characters away but never more than the session has, so the session is a sum reflected at zero.  An interval over
    midnight counts for the day on which it ends.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    first = updates.withColumn("n", F.row_number().over(Window.partitionBy(*keys, F.expr("unix_millis(ts)")).orderBy("ts", "event_id"))).where("n = 1")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = first.withColumn("switch", F.last(F.when(F.col("event") != "update", F.col("event")), ignorenulls=True).over(before)).withColumn("tracking", F.coalesce(F.col("switch") == "start", F.lit(False)))
    rows = rows.withColumn("last_ts", F.lag("ts").over(w)).withColumn("last_position", F.lag("position").over(w))
    counted = F.col("tracking") & (F.col("event") != "start")
    ms = F.expr("unix_millis(ts) - unix_millis(last_ts)")
    rows = rows.withColumn("ms", F.when(counted, ms).otherwise(0)).withColumn("diff", F.when(counted, F.col("position") - F.col("last_position")).otherwise(0))
    total = F.sum("diff").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("p", total)
    floor = F.least(F.lit(0), F.min("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("session", F.col("p") - floor)
    gain = F.col("session") - F.coalesce(F.lag("session").over(w), F.lit(0))
    rows = rows.withColumn("gain", gain)
    return rows.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("ms").cast("bigint").alias("ms"), F.sum("gain").cast("bigint").alias("characters"))


class Tracker:
    """The same fold for one key, row by row."""

    def __init__(self, state: str | None = None):
        self.tracking, self.at, self.position, self.session = json.loads(state) if state else (False, None, 0, 0)

    def save(self) -> str:
        return json.dumps([self.tracking, self.at, self.position, self.session])

    def feed(self, rows: Iterable[tuple[int, str, int]]) -> dict[int, list[int]]:
        """Milliseconds and characters by day number; rows (ms, event, position) in order."""
        days: dict[int, list[int]] = {}
        for ms, event, position in rows:
            if self.at is not None and ms <= self.at:
                continue
            day = days.setdefault(ms // DAY_MS, [0, 0])
            if self.tracking and event != "start":
                diff = max(position - self.position, -self.session)
                day[0] += ms - self.at
                day[1] += diff
                self.session += diff
            self.at, self.position = ms, position
            if event != "update":
                self.tracking = event == "start"
        return days


def track_reading(updates: DataFrame, idle_ms: int = 7 * DAY_MS) -> DataFrame:
    """Streaming twin of track_reading_batch: one row for each key, day and trigger with what was added."""

    def fold(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker(state.get[0] if state.exists else None)
        rows = pd.concat(list(parts))
        ms = rows["ts"].astype("datetime64[us]").astype("int64") // 1000
        order = rows.assign(ms=ms).sort_values(["ts", "event_id"])
        days = tracker.feed(zip(order["ms"].tolist(), order["event"].tolist(), order["position"].tolist()))
        state.update((tracker.save(),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, pd.Timestamp(d * DAY_MS, unit="ms").date(), m, c) for d, (m, c) in sorted(days.items())], columns=["reader", "book", "day", "ms", "characters"])

    out = "reader bigint, book bigint, day date, ms bigint, characters bigint"
    return updates.groupBy("reader", "book").applyInPandasWithState(fold, out, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout)


OPEN, SHUT = 0.5, 0.35  # fixed values: activity opens at the one and counts as silence below the other
LEAD, TAIL = 16_000, 4_000  # fixed values: samples before and after a segment that a recogniser is given
SEGMENTS = "recording bigint, start bigint, end bigint, hard_cut boolean, padded_start bigint, padded_end bigint"


class Walk(NamedTuple):
    """What a walk over frames found, and where the segment that is still open begins (None: none is open)."""

    segments: list[tuple[int, int, bool]]
    open_at: int | None
    continued: bool


def walk(probability: np.ndarray, samples: np.ndarray, quiet: int, cap: int, least: int, offset: int = 0, open_at: int | None = None, continued: bool = False, last: bool = True) -> Walk:
    """Segments of frames that follow each other from sample offset on; open_at: a segment is open since there.

    A segment begins at a frame of OPEN or more.  It ends where a silence of quiet samples began, or, once it is cap long, where the
    present silence began, or else right there, and then the next one continues it.  Segments under least samples that end in a full
    silence are dropped unless they continue another.  Each step leaps to the next such event.
    """
    ends = offset + np.cumsum(samples)
    starts = ends - samples
    silent = probability < SHUT
    fresh = silent & ~np.append(False, silent[:-1])
    since = np.maximum.accumulate(np.where(fresh, np.arange(len(ends)), 0)) if len(ends) else np.zeros(0, int)
    silence = starts[since]  # of a silent frame: where its silence began
    loud = np.flatnonzero(probability >= OPEN)
    shut = np.flatnonzero(silent & (ends - silence >= quiet))
    first = lambda places, k: int(places[i]) if (i := np.searchsorted(places, k)) < len(places) else len(ends)
    out, at = [], 0
    while True:
        if open_at is None:
            at = first(loud, at)
            if at == len(ends):
                return Walk(out, None, False)
            open_at = int(starts[at])
        closing, full = first(shut, at), max(at, int(np.searchsorted(ends, open_at + cap)))
        if min(closing, full) == len(ends):
            break
        if closing <= full:
            if continued or silence[closing] - open_at >= least:
                out.append((open_at, int(silence[closing]), False))
            open_at, continued, at = None, False, closing + 1
        elif silent[full]:
            out.append((open_at, int(silence[full]), False))
            open_at, continued, at = None, False, full + 1
        else:
            out.append((open_at, int(ends[full]), True))
            open_at, continued, at = int(ends[full]), True, full + 1
    if last and len(ends):
        end = int(silence[-1] if silent[-1] else ends[-1])
        if continued or end - open_at >= least:
            out.append((open_at, end, False))
    return Walk(out, open_at, continued)


def _padded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("padded_start", F.greatest(F.col("start") - LEAD, F.lit(0)).cast("bigint")).withColumn("padded_end", F.col("end") + TAIL)


def hysteresis_segments(frames: DataFrame, quiet: int = 8000, cap: int = 320_000, least: int = 4000) -> DataFrame:
    """Segments of activity (recording, start, end, hard_cut, padded_start, padded_end) from frames (recording, ord, probability, samples).

    Activity is certainly over at every frame whose silence is quiet long, so these frames divide a recording into islands, and
    what happens in an island needs no look at others.  Islands shorter than cap are one segment and are found by windows; only
    those that must be cut are gathered, each on its own, and walked from cut to cut.
    """
    order = Window.partitionBy("recording").orderBy("ord")
    silent = F.col("probability") < SHUT
    rows = frames.select("recording", "ord", "probability", "samples").withColumn("to", F.sum("samples").over(order)).withColumn("from", F.col("to") - F.col("samples"))
    fresh = silent & ~F.coalesce(F.lag(silent).over(order), F.lit(False))
    rows = rows.withColumn("silence", F.when(silent, F.last(F.when(fresh, F.col("from")), ignorenulls=True).over(order)))
    rows = rows.withColumn("shut", F.coalesce(F.col("to") - F.col("silence") >= quiet, F.lit(False)))
    rows = rows.withColumn("island", F.coalesce(F.sum(F.col("shut").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    of = Window.partitionBy("recording", "island")
    rows = rows.withColumn("start", F.min(F.when(F.col("probability") >= OPEN, F.col("from"))).over(of)).where("start is not null and from >= start")
    full = F.max(F.when(~F.col("shut"), F.col("to"))).over(of) - F.col("start") >= cap
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)))
    end = F.max_by(F.when(F.col("probability") < SHUT, F.col("silence")).otherwise(F.col("to")), "ord").alias("end")
    whole = rows.where(~F.col("full")).groupBy("recording", "island").agg(F.min("start").alias("start"), end).where(F.col("end") - F.col("start") >= least)
    whole = whole.select("recording", "start", "end", F.lit(False).alias("hard_cut"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        found = walk(pdf["probability"].to_numpy(), pdf["samples"].to_numpy(), quiet, cap, least, int(pdf["from"].iloc[0])).segments
        return pd.DataFrame([(pdf["recording"].iloc[0], *x) for x in found], columns=["recording", "start", "end", "hard_cut"])

    parts = rows.where("full").select("recording", "island", "ord", "probability", "samples", "from").groupBy("recording", "island").applyInPandas(cut, "recording bigint, start bigint, end bigint, hard_cut boolean")
    return _padded(whole.unionByName(parts))


def hysteresis_segments_stream(frames: DataFrame, idle_ms: int = DAY_MS, quiet: int = 8000, cap: int = 320_000, least: int = 4000) -> DataFrame:
    """Streaming twin: closed segments as they appear; what is open when a recording falls silent for idle_ms is given then.

    The state holds the frames since the open segment began: about cap samples at most.
    """
    columns = ["recording", "start", "end", "hard_cut"]

    def fold(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState):
        probability, samples, offset, open_at, continued = json.loads(state.get[0]) if state.exists else ([], [], 0, None, False)
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("ord")
            probability, samples = probability + rows["probability"].tolist(), samples + rows["samples"].tolist()
        p, n = np.array(probability, float), np.array(samples, np.int64)
        found = walk(p, n, quiet, cap, least, offset, open_at, continued, last=state.hasTimedOut)
        if state.hasTimedOut:
            state.remove()
        else:
            begins = offset + np.cumsum(n) - n
            keep = len(p) if found.open_at is None else int(np.searchsorted(begins, found.open_at))
            now = int(begins[keep]) if keep < len(p) else offset + int(n.sum())
            state.update((json.dumps([p[keep:].tolist(), n[keep:].tolist(), now, found.open_at, found.continued]),))
            state.setTimeoutDuration(idle_ms)
        out = pd.DataFrame([(*key, *x) for x in found.segments], columns=columns)
        yield out.assign(padded_start=(out["start"].astype("int64") - LEAD).clip(lower=0), padded_end=out["end"].astype("int64") + TAIL)

    return frames.groupBy("recording").applyInPandasWithState(fold, SEGMENTS, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout)


PHRASE_DRIFT, WORD_DRIFT = 0.75, 0.25  # fixed values: seconds that a repeated phrase, or a single symbol, may have moved
MEMORY = 1.0  # fixed value: seconds before a batch's end whose tokens the next one may repeat


Token = tuple[str, float, float]  # text, start, end


def repeated_prefix(known: list[Token], new: list[Token], heard_to: float) -> int:
    """How many leading tokens of new repeat the last ones of known."""
    if not new or not known or new[0][1] >= heard_to:
        return 0
    begin, symbols, most = new[0][1], set(), 0
    for n in range(1, min(len(known), len(new)) + 1):
        symbols.update(new[n - 1][0])
        drift = abs(known[-n][1] - begin)
        if drift <= (PHRASE_DRIFT if n > 1 and len(symbols) > 1 else WORD_DRIFT) and all(a[0] == b[0] for a, b in zip(known[-n:], new)):
            most = n
    return most


def spread(new: list[Token], heard_to: float) -> list[tuple[str, float, float, float, float]]:
    """new with at and to: its own times, but tokens that would begin before heard_to share the time from there to the first that begins later."""
    crowd = 0
    if new and new[0][1] < heard_to:
        crowd = next((k for k, (_, start, _) in enumerate(new) if start > heard_to), len(new))
    if not crowd:
        return [(*t, t[1], t[2]) for t in new]
    limit = new[crowd][1] if crowd < len(new) else new[-1][2]
    edges = [heard_to + (limit - heard_to) * k / crowd for k in range(crowd + 1)]
    return [(*t, edges[k], edges[k + 1]) if k < crowd else (*t, t[1], t[2]) for k, t in enumerate(new)]


class Heard:
    """What stitching keeps of a recording: the last tokens, and where the next ones may begin."""

    def __init__(self, begin: float, heard_to: float | None = None, known: Iterable[Token] = ()):
        self.begin, self.heard_to = begin, begin if heard_to is None else heard_to
        self.known: list[Token] = [tuple(t) for t in known]

    def accept(self, segment_start: float, through: float, tokens: Iterable, first: bool, crowded: bool = True) -> list[tuple[str, float, float, float, float]]:
        """The tokens (text, start, end, at, to) of the next batch that are new; crowded: whether they may have to share their time."""
        new = [(t["text"], t["start"], t["end"]) for t in tokens]
        if first:
            new = [t for t in new if t[1] >= self.begin]
        else:
            new = new[repeated_prefix([t for t in self.known if t[2] >= segment_start], new, self.heard_to) :]
        out = [t for t in spread(new, self.heard_to if crowded else -math.inf) if t[4] > t[3]]
        self.known = [t for t in [*self.known, *(x[:3] for x in out)] if t[2] >= through - MEMORY]
        self.heard_to = max([self.heard_to, *(t[4] for t in out)])
        return out


def stitch_stream(batches: DataFrame, start: float = 0.0, idle_ms: int = DAY_MS) -> DataFrame:
    """stitch_batches over a stream: (recording, ord, text, start, end) as batches come, in append mode.

    State of a recording is the end of its last batch, the tokens of its last second and two numbers.  Batches that end no later
    than one that has been stitched are ignored, whenever they come; state of a recording that is silent for idle_ms goes.
    """
    schema = "recording bigint, ord bigint, text string, start double, end double"

    def fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, through, n, heard_to, known = json.loads(state.get[0]) if state.exists else (False, start, 0, start, [])
        heard, out = Heard(start, heard_to, known), []
        pdf = pd.concat(list(frames)).assign(order=lambda x: [tuple((t["text"], t["start"], t["end"]) for t in tokens) for tokens in x["tokens"]])
        for row in pdf.sort_values(["through", "segment_start", "order"]).itertuples(index=False):
            if row.through <= through:
                continue
            new = heard.accept(row.segment_start, row.through, row.tokens, not begun)
            begun, through = True, float(row.through)
            if new:
                out.append(pd.DataFrame([(key[0], n + k, text, at, to) for k, (text, _, _, at, to) in enumerate(new)], columns=["recording", "ord", "text", "start", "end"]))
            n += len(new)
        state.update((json.dumps([begun, through, n, float(heard.heard_to), heard.known]),))
        state.setTimeoutDuration(idle_ms)
        yield from out

    return batches.groupBy("recording").applyInPandasWithState(fold, schema, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stitch_batches(batches: DataFrame, start: float = 0.0) -> DataFrame:
    """Tokens (recording, ord, text, start, end) from batches (recording, segment_start, through, tokens array<struct<text, start, end>>).

    Batches count in order of through; of those with one through only the first.  A batch that begins, with all its tokens, after
    the end of every token before it, and ends more than MEMORY later, is untouched by what came before.  Such batches divide a recording into stretches, which are
    stitched apart: leading tokens that repeat known ones go, and early ones are fitted in after what was heard.
    """
    order = Window.partitionBy("recording").orderBy("through")
    rows = batches.withColumn("n", F.row_number().over(Window.partitionBy("recording", "through").orderBy("segment_start", "tokens"))).where((F.col("n") == 1) & (F.col("through") > start))
    heard = F.max(F.array_max("tokens.end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("heard", F.greatest(heard, F.lit(start))).withColumn("begin", F.least("segment_start", F.array_min("tokens.start")))
    first = F.row_number().over(order) == 1
    fresh = (F.col("begin") > F.col("heard")) & (F.col("heard") < F.col("through") - MEMORY) & F.exists("tokens", lambda t: t["end"] > t["start"])
    rows = rows.withColumn("first", first).withColumn("apart", fresh | F.col("first"))
    rows = rows.withColumn("stretch", F.sum(F.col("apart").cast("bigint")).over(order))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a stretch follow each other, and many stretches share a task: a call for each would cost more than its work."""
        last, heard = None, Heard(start)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                key = (row["recording"], row["stretch"])
                begins = key != last
                if begins:
                    last, heard = key, Heard(start)
                new = heard.accept(row["segment_start"], row["through"], row["tokens"], row["first"], not begins or row["first"])
                out += [(key[0], row["through"], k, text, at, to) for k, (text, _, _, at, to) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, types)], names)

    names, types = ["recording", "through", "k", "text", "start", "end"], [pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
    rows = rows.select(F.col("recording").cast("bigint").alias("recording"), "stretch", "first", F.col("segment_start").cast("double").alias("segment_start"), F.col("through").cast("double").alias("through"), "tokens")
    found = rows.repartition("recording").sortWithinPartitions("recording", "through").mapInArrow(stitch, "recording bigint, through double, k bigint, text string, start double, end double")
    place = F.row_number().over(Window.partitionBy("recording").orderBy("through", "k")) - 1
    return found.select("recording", place.cast("bigint").alias("ord"), "text", "start", "end")


def noise_floor_activity(frames: DataFrame, frames_back: int = 938, share: float = 0.10) -> DataFrame:
    """Probability of speech of frames (recording, ord, level in dB from -100 to 0) over a rolling noise floor.

    The floor is the smallest whole level with more than share of the last frames at or below it; missing history counts as -100.
    Per level the frames at or below it are counted in the window, as a running sum that the window slides over, so a row holds 101
    counts and never the history.
    """
    w = Window.partitionBy("recording").orderBy("ord")
    level = F.greatest(F.lit(-100.0), F.least(F.lit(0.0), F.col("level")))
    rows = frames.select("recording", "ord", level.alias("level")).withColumn("bin", F.floor(F.col("level") + 0.5).cast("int") + 100).withColumn("n", F.row_number().over(w))
    least = math.floor(frames_back * share) + 1
    # running counts of each bin, taken at this row and at the last row that has left the window
    counts = [F.sum((F.col("bin") == k).cast("int")).over(w).alias(f"c{k}") for k in range(101)]
    counted = rows.select("recording", "ord", "level", "n", F.array(*counts).alias("counts"))
    gone = F.coalesce(F.lag("counts", frames_back).over(w), F.array_repeat(F.lit(0).cast("bigint"), 101))
    counted = counted.withColumn("inside", F.zip_with("counts", gone, lambda a, b: a - b))
    missing = F.greatest(F.lit(frames_back) - F.col("n"), F.lit(0)).cast("bigint")  # they lie in bin 0
    reach = F.aggregate("inside", F.struct(missing.alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("k")), lambda s, c: F.struct((s["sum"] + c).alias("sum"), F.when((s["at"] < 0) & (s["sum"] + c >= least), s["k"]).otherwise(s["at"]).alias("at"), (s["k"] + 1).alias("k")))
    rows = counted.withColumn("floor", reach["at"] - 100)
    threshold = F.least(F.greatest(F.col("floor") + 12, F.lit(-55)), F.lit(-30))
    return rows.select("recording", "ord", "floor", (1.0 / (1.0 + F.exp(-(F.col("level") - threshold) / 2.0))).alias("probability"))


def upsert_stream(stream: DataFrame, table: BucketedTable, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, interval: str = "15 seconds"):
    """Start a stream that merges each micro-batch into a table; a version is named by its batch, so a replayed batch changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(batch, merge, number)
        table.vacuum()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "15 seconds"):
    """Hand on the changes of an aggregate at most once an interval, the first at once."""
    return stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=interval)
