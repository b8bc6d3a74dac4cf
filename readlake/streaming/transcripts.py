"""Append-only realignment: a transcript that grows batch by batch, with what earlier batches settled kept in tables.

State lives in a folder, with a subfolder for each table and version (batch).  A version has rows of the books that its batch touched, and
`heads` names the version that holds each book; it is written last, so a version without it never counts and a batch that is run
again writes the same rows anew.  For a touched book,

- only new characters, and the last few before them, are looked up among the seeds of the text, which are made anew;
- a stretch is joined anew only if it reaches those; the others are copied;
- the chain of stretches is chosen again, which is a fold over one row a stretch;
- only gaps whose bounds or whose neighbours' reach have changed are repaired again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readlake.operators import transcript as S
from readlake.sources.staging import Staging

GAP = ["book", "low", "high", "s_low", "s_high", "reach_low", "reach_high"]


class TranscriptSession:
    """Alignment of growing transcripts with the chapters (book, chapter, text) of their books, kept in a folder that all executors share."""

    def __init__(self, chapters: DataFrame, folder: str):
        self.spark: SparkSession = chapters.sparkSession
        self.folder = folder.rstrip("/")
        self.kind = chapters.schema["book"].dataType.simpleString()
        if not self._exists("text/cues"):  # the text does not change: it is cut and written once
            written = self._write(S.written_chapters(chapters), "text/written")
            self._write(S.ends_of(chapters, written, False), "text/sentences")
            ends = self._write(S.ends_of(chapters, written, True), "text/ends")
            self._write(S.cue_intervals(ends, written), "text/cues")
        self.written, self.sentences, self.ends, self.intervals = (self._read(f"text/{n}") for n in ("written", "sentences", "ends", "cues"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(f"{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        root = self._path("heads")
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = [int(f.getPath().getName().removeprefix("v=")) for f in files.listStatus(root)] if files.exists(root) else []
        return sorted(v for v in found if self._exists(f"heads/v={v}"))

    def _state(self, name: str, schema: str, before: int) -> DataFrame:
        """Rows of a table as of the versions below one: of each book those of its latest version, or of all versions where rows only add up."""
        committed = [v for v in self.versions() if v < before]
        if not committed:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])  # without a task in Python
        rows = self.spark.read.schema(f"{schema}, v int").option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/v={v}" for v in committed])
        if name == "characters":
            return rows.drop("v")
        if name == "heads":
            return rows.groupBy("book").agg(F.max("v").alias("v"), F.max_by("n", "v").alias("n"))
        return rows.join(self._state("heads", f"book {self.kind}, n bigint", before).select("book", "v"), ["book", "v"]).drop("v")

    def update(self, tokens: DataFrame, version: int) -> None:
        """Take in a batch of tokens (book, ord, text, start, end), which follow all earlier ones of their books; fit for foreachBatch."""
        if version in self.versions():
            return
        b = self.kind
        staging = Staging(self.spark)
        heads = self._state("heads", f"book {b}, n bigint", version)
        fresh = S.spoken_pieces(tokens).join(heads.select("book", "n"), "book", "left").withColumn("p", F.col("p") + F.coalesce("n", F.lit(0))).drop("n")
        fresh = self._write(fresh, f"characters/v={version}")
        touched = staging.keep(fresh.groupBy("book").agg(F.min("p").alias("from"), F.max(S.piece()[1]).alias("n")))
        told = self._state("characters", f"book {b}, p bigint, t string, start double, end double", version).join(touched.select("book", "from"), "book")
        first = F.greatest("p", F.col("from") - (S.SEED - 1))
        tail = told.where(S.piece()[1] > F.col("from") - (S.SEED - 1)).select("book", first.alias("p"), F.substring(F.col("t"), (first - F.col("p") + 1).cast("int"), F.length("t")).alias("t"), "start", "end")
        pairs = S.seed_pairs(tail.unionByName(fresh), self.written.join(touched, "book", "left_semi"))
        known = self._state("stretches", f"book {b}, w bigint, s bigint, length int", version).join(touched.select("book", "from"), "book")
        open_ = F.col("s") + F.col("length") > F.col("from") - S.SEED
        grown = S.stretches_of(known.where(open_).drop("from").unionByName(pairs))
        stretches = self._write(known.where(~open_).drop("from").unionByName(grown), f"stretches/v={version}")
        chosen = self._write(S.chained(stretches), f"chosen/v={version}")
        gaps = staging.keep(S.gaps_between(chosen))
        old = self._state("gaps", f"book {b}, low bigint, high bigint, s_low bigint, s_high bigint, reach_low bigint, reach_high bigint, similarity double, times array<struct<at:bigint,start:double,end:double>>", version)
        new = gaps.join(old.select(*GAP), GAP, "left_anti")
        around = told.drop("from").unionByName(fresh)
        repaired = self._write(S.repaired(new, around, self.written, self.sentences, self.ends).join(new, GAP[:5]), f"repaired/v={version}")
        self._write(old.join(gaps.select(*GAP), GAP, "left_semi").unionByName(repaired.select(*old.columns)), f"gaps/v={version}")
        self._write(touched.select("book", "n"), f"heads/v={version}")
        staging.drop()

    def repaired(self, version: int) -> DataFrame:
        """The gaps that a version worked on: all others were taken over."""
        return self._read(f"repaired/v={version}")

    def cues(self, touched_by: int | None = None) -> DataFrame:
        """(book, chapter, start_at, length, start, end) as of the latest version, of all books or of those that a version touched: the rows of align_transcript."""
        latest = max(self.versions(), default=-1) + 1
        b = self.kind
        tables = [self._state("chosen", f"book {b}, w bigint, s bigint, length int", latest), self._state("gaps", f"book {b}, times array<struct<at:bigint,start:double,end:double>>", latest), self._state("characters", f"book {b}, p bigint, t string, start double, end double", latest)]
        texts = [self.written, self.sentences, self.ends, self.intervals]
        if touched_by is not None:
            books = self._read(f"heads/v={touched_by}").select("book")
            tables, texts = ([t.join(books, "book", "left_semi") for t in x] for x in (tables, texts))
        chosen, gaps, characters = tables
        written, sentences, ends, intervals = texts
        staging = Staging(self.spark)
        characters = staging.keep(characters)
        timed = staging.keep(S.timed_pieces(chosen, gaps, characters))
        return S.cues_from_times(timed, characters, written, sentences, ends, staging, intervals=intervals)
