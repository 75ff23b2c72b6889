"""Documents that arrive paragraph by paragraph: a state machine a document, kept between batches.

Each row is (doc_id, para_no, text, last). Order inside a batch isn't given, so rows wait until those before them have
come; the machine then goes on from its state. The row marked last closes the document. The output is, byte for byte,
that of the batch form."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import html as H
from quire.operators import machine
from quire.operators.convert import load_rules
from quire.options import ConvertOptions, OptionError, settled

OUT = "doc_id long, para_no int, html string"
STATE = "next int, machine binary, waiting binary"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_no, text, last: a table of documents as such a stream would bring it."""
    from quire.operators.records import records

    own = records(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.size(own).alias("n"), F.posexplode(own).alias("para_no", "text")).select("doc_id", "para_no", "text", (F.col("para_no") + 1 == F.col("n")).alias("last"))


def to_html(rows: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """doc_id, para_no, html: the HTML of each paragraph as soon as all before it are there."""
    options = settled(options or ConvertOptions())
    for name in ("section", "toc", "number_headings", "lang_runs", "citations", "glossary", "chunk", "report"):
        if getattr(options, name):
            raise OptionError(f"{name} needs the whole document")
    rules = load_rules(options)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            due, kept, held = state.get
            writer, waiting = machine.Writer(options, rules).restore(pickle.loads(kept)), pickle.loads(held)
        else:
            due, writer, waiting = 0, machine.Writer(options, rules), {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.para_no >= due:  # a row that comes again is known
                    waiting[int(r.para_no)] = (r.text, bool(r.last))
        out, ended = [], False
        while due in waiting:
            text, last = waiting.pop(due)
            html = (writer.start(text) if due == 0 else "") + writer.record(text)
            if last:
                html += writer.finish() + writer.tail()
                ended = True
            out.append((key[0], due, html))
            due += 1
        if ended:
            state.remove()
        else:
            state.update((due, pickle.dumps(writer.state()), pickle.dumps(waiting)))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "para_no", "html"])

    return rows.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def structure(lines: DataFrame) -> DataFrame:
    """Running totals by document over a stream of paragraphs, natively."""
    counted = H.counts(F.col("html"))
    return lines.groupBy("doc_id").agg(*[F.sum(c).alias(n) for n, c in counted.items()])


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files of (doc_id, para_no, text, last)."""
    return spark.readStream.schema("doc_id long, para_no int, text string, last boolean").parquet(path)


def debounced(requests: DataFrame, delay: str = "300 milliseconds", key: str = "doc_id", at: str = "at") -> DataFrame:
    """key, due, requests and the columns of the newest request: one row for each burst of requests for a document, due once
    none has come for the delay. The same over a table and over a stream, where a burst comes out when its time is over."""
    rest = [c for c in requests.columns if c not in (key, at)]
    bursts = requests.withWatermark(at, delay).groupBy(F.session_window(at, delay).alias("burst"), key)
    found = bursts.agg(F.count("*").alias("requests"), F.max_by(F.struct(*rest), at).alias("newest"))
    return found.select(key, F.col("burst.end").alias("due"), "requests", "newest.*")
