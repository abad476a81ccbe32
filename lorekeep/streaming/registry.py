"""Sessions as keyed state: what is known of a session grows with its messages, and a quiet one is settled by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

#: The last values of these are kept, whatever part of the log brings them.
TOLD = ("cwd", "branch", "model")
STATE = "messages bigint, started bigint, ended bigint, title string, title_at string, status string, reopened bigint, " + ", ".join(f"{c} string, {c}_at string" for c in TOLD)
NAMES = [x.split()[0] for x in STATE.split(", ")]
UPDATES = "agent string, session string, status string, reopened bigint, messages bigint, started timestamp, ended timestamp, title string, cwd string, branch string, model string, mentions map<string, bigint>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionRegistry(StatefulProcessor):
    """State of a key (agent, session): its summary, and how often each name is mentioned."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", STATE)
        self.mentions = handle.getMapState("mentions", "name string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = dict(zip(NAMES, self.summary.get(), strict=True)) if self.summary.exists() else dict.fromkeys(NAMES) | {"messages": 0, "reopened": 0}
        counts: dict[str, int] = {}
        for part in rows:
            for row in part.itertuples(index=False):
                absorb(known, row)
                for name in row.names if row.names is not None else ():
                    counts[name] = counts.get(name, 0) + 1
        known["reopened"] += known["status"] == "settled"
        known["status"] = "open"
        self.summary.update(tuple(known[n] for n in NAMES))
        for name, n in counts.items():
            before = self.mentions.getValue((name,)) if self.mentions.containsKey((name,)) else (0,)
            self.mentions.updateValue((name,), (before[0] + n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self.told(key, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = dict(zip(NAMES, self.summary.get(), strict=True)) | {"status": "settled"}
        self.summary.update(tuple(known[n] for n in NAMES))
        yield self.told(key, known)

    def told(self, key, known: dict) -> pd.DataFrame:
        import pandas as pd

        at = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        mentions = {k[0]: v[0] for k, v in self.mentions.iterator()}
        row = [*key, known["status"], known["reopened"], known["messages"], at(known["started"]), at(known["ended"]), known["title"], *(known[c] for c in TOLD), mentions]
        return pd.DataFrame([row], columns=[x.split()[0] for x in UPDATES.replace("string, bigint", "").split(", ")])

    def close(self) -> None:
        pass


def absorb(known: dict, row) -> None:
    """One message into a summary; messages may come in any order."""
    known["messages"] += 1
    if row.at_us == row.at_us and row.at_us is not None:
        at = int(row.at_us)
        known["started"] = at if known["started"] is None else min(known["started"], at)
        known["ended"] = at if known["ended"] is None else max(known["ended"], at)
    if row.role == "user" and (known["title_at"] is None or row.place < known["title_at"]):
        known["title"], known["title_at"] = row.text[:80], row.place
    for c in TOLD:
        value = getattr(row, c)
        if value is not None and (known[f"{c}_at"] is None or row.place >= known[f"{c}_at"]):
            known[c], known[f"{c}_at"] = value, row.place


def session_states(messages: DataFrame, quiet: str = "30 minutes") -> DataFrame:
    """A stream of UPDATES from a stream of messages: a row for each session that a batch touches, and one when it is settled.

    messages may have a column names (array of strings), the names that a message mentions. A session without a message for
    `quiet` is settled; one that is settled and goes on is open again, and reopened counts how often. The first user message
    (by file and place) is the title, of cwd, branch and model the last value counts. Only touched keys are read and
    written, so a batch costs what it brings, not what the registry holds. Needs the RocksDB state store (PROVIDER).
    """
    import pandas as pd

    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    names = F.col("names") if "names" in messages.columns else F.array().cast("array<string>")
    place = F.concat_ws("|", "path", F.lpad(F.col("seq.block").cast("string"), 20, "0"), F.lpad(F.col("seq.row").cast("string"), 20, "0"))
    rows = messages.select("agent", "session", "role", "text", *TOLD, F.unix_micros("at").alias("at_us"), place.alias("place"), names.alias("names"))
    return rows.groupBy("agent", "session").transformWithStateInPandas(SessionRegistry(quiet_ms), UPDATES, "Update", "ProcessingTime")
