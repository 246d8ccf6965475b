"""Streams with keyed state of their own: the exact fold of saves, and exact bursts of layout changes.

Both need the state store that keeps lists, maps and timers (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tmspark.functions import text
from tmspark.operators import memory

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an entry holds besides its id and the phrase it is kept under.
ENTRY = "id long, source_text string, ai_translation string, final_translation string, kind string, page_id long, bubble_id string, reuse_count int, created_at timestamp"
CHANGE_SCHEMA = f"change string, {memory.FOLD_SCHEMA}"
BURST_SCHEMA = "page_id long, seq long, op string, bubble string, at timestamp, last_at timestamp, n long"


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store of streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _records(frames: Iterator[pd.DataFrame], by: list[str]) -> list[dict]:
    """The rows of a key in order, with None for what is missing."""
    rows = pd.concat(list(frames)).sort_values(by, kind="stable").astype(object)
    return rows.where(rows.notna(), None).to_dict("records")


def _plain(value):
    """A value as the state stores take it."""
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


class Fold(StatefulProcessor):
    """A phrase's entries by their place, and how many there are. An event reads and writes the latest entry only; what
    comes out are the entries that a batch of events changed, added or removed."""

    def __init__(self, settings: dict, ttl_ms: int | None):
        self.settings, self.ttl_ms = settings, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "place int", ENTRY, self.ttl_ms)
        self.top = handle.getValueState("top", "n int", self.ttl_ms)
        self.names = [field.split()[0] for field in ENTRY.split(", ")]

    def _entry(self, place: int) -> dict | None:
        return dict(zip(self.names, self.entries.getValue((place,)))) if place > 0 and self.entries.containsKey((place,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        project, phrase = key
        before = top = self.top.get()[0] if self.top.exists() else 0
        stored, held, gone = {}, {}, []  # the entry of each place as the state has it, and as it is now

        def latest() -> dict | None:
            if top not in held:
                stored[top] = held[top] = self._entry(top)
            return held[top]

        for event in _records(rows, ["seq"]):
            last = latest()
            action, entry = memory.fold_step(last, event, **self.settings)
            if action == "add":
                top += 1
                stored.setdefault(top, self._entry(top) if top <= before else None)
                held[top] = entry
            elif action == "change":
                held[top] = entry
            elif action == "remove":
                held[top] = None
                top -= 1
        out = []
        for place, entry in held.items():
            entry, old = (entry if place <= top else None), stored.get(place)
            entry = entry and {name: _plain(entry[name]) for name in self.names}
            if entry is not None and entry != old:
                self.entries.updateValue((place,), tuple(entry[name] for name in self.names))
                out.append({"change": "set", **entry})
            if old is not None and (entry is None or entry["id"] != old["id"]):
                gone.append({"change": "remove", **old})
                if entry is None:
                    self.entries.removeKey((place,))
        if top != before or self.ttl_ms:
            self.top.update((top,))
        frame = pd.DataFrame(gone + out, columns=["change", *self.names], dtype=object).assign(project_id=project, phrase_key=phrase)
        yield frame[[field.split()[0] for field in CHANGE_SCHEMA.split(", ")]]


def fold_changes(saves: DataFrame, ttl_ms: int | None = None, **settings) -> DataFrame:
    """The changes of the memory that each batch of ordered saves and uses makes (update mode): ``change`` is set or
    remove, for the entry of that id. Applied in order of batches they give what the batch operator gives.

    State is a row an entry; a phrase without events for ``ttl_ms`` is forgotten."""
    keyed = saves.withColumn("phrase_key", text.normalize_phrase(F.col("source_text")))
    mode = "processingTime" if ttl_ms else "none"
    return keyed.groupBy("project_id", "phrase_key").transformWithStateInPandas(Fold(settings, ttl_ms), CHANGE_SCHEMA, "Update", mode)


class Bursts(StatefulProcessor):
    """A page's operations wait until the watermark has passed them, so they are gone through in order of time; the last
    one stays open until another operation or the gap closes it."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, op string, bubble string, detail string, at timestamp")
        self.open = handle.getValueState("open", "seq long, op string, bubble string, detail string, at timestamp, last_at timestamp, n long")

    @staticmethod
    def _ms(at) -> int:
        return int(pd.Timestamp(at).value // 1_000_000)

    def _go_on(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get())
        ready = sorted((row for row in waiting if self._ms(row[4]) < watermark), key=lambda row: (row[4], row[0]))
        later = [row for row in waiting if self._ms(row[4]) >= watermark]
        last, done = (tuple(self.open.get()) if self.open.exists() else None), []
        for seq, op, bubble, detail, at in ready:
            joins = last is not None and op in ("layout", "layout_bulk") and (op, bubble, detail) == last[1:4]
            if joins and 0 <= (pd.Timestamp(at) - pd.Timestamp(last[5])).total_seconds() * 1000 <= self.gap_ms:
                last = (*last[:5], at, last[6] + 1)
                continue
            if last is not None:
                done.append(last)
            last = (seq, op, bubble, detail, at, at, 1)
        if last is not None and self._ms(last[5]) + self.gap_ms < watermark:
            done.append(last)
            last = None
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if last is not None:
            self.open.update(last)
            self.handle.registerTimer(self._ms(last[5]) + self.gap_ms + 1)
        elif self.open.exists():
            self.open.clear()
        if later:
            self.handle.registerTimer(min(self._ms(row[4]) for row in later) + 1)
        rows = [(key[0], seq, op, bubble, at, last_at, n) for seq, op, bubble, _, at, last_at, n in done]
        yield pd.DataFrame(rows, columns=[field.split()[0] for field in BURST_SCHEMA.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(_plain(row[c]) for c in ("seq", "op", "bubble", "detail", "at")) for row in _records(rows, ["at", "seq"])]
        self.waiting.appendList(new)
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs())


def layout_bursts(ops: DataFrame, gap_seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """Operations of pages (page_id, seq, op, bubble, detail, at), repeated layout changes merged as the batch operator
    ``coalesce_ops`` merges them: only with the page's last operation, so any other one in between parts them (append
    mode). A burst is given out when the watermark shows that nothing can join it; later rows are dropped."""
    rows = ops.select("page_id", F.col("seq").cast("long").alias("seq"), "op", "bubble", "detail", "at").withWatermark("at", watermark)
    return rows.groupBy("page_id").transformWithStateInPandas(Bursts(gap_seconds * 1000), BURST_SCHEMA, "Append", "eventTime")


USAGE_SCHEMA = (
    "provider string, key_id string, model string, at timestamp, day string, today long, limit_day int, limit_source string, limit_minute int, left int, exhausted boolean"
)


class Usage(StatefulProcessor):
    """A key and model: requests by quota day, the day's and the minute's limit, what the server said is left, and the day
    that is used up. Limits are kept with their time, so one that arrives late doesn't replace a newer one."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.requests = handle.getMapState("requests", "day string", "n long")
        self.slot = handle.getValueState(
            "slot", "at timestamp, day string, named int, named_at timestamp, guess int, guess_at timestamp, minute int, minute_at timestamp, left int, left_day string, left_at timestamp, spent string"
        )
        self.names = "at day named named_at guess guess_at minute minute_at left left_day left_at spent".split()

    def _count(self, day: str) -> int:
        return self.requests.getValue((day,))[0] if self.requests.containsKey((day,)) else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot = dict(zip(self.names, self.slot.get())) if self.slot.exists() else dict.fromkeys(self.names)
        newer = lambda at, name: slot[name] is None or pd.Timestamp(at) >= pd.Timestamp(slot[name])
        for event in _records(rows, ["at", "turn"]):
            at, day, number = _plain(event["at"]), event["day"], int(event["limit_value"] or 0)
            if newer(at, "at"):
                slot |= {"at": at, "day": day}
            if event["kind"] == "success":
                self.requests.updateValue((day,), (self._count(day) + 1,))
            elif event["kind"] == "server_counts":
                if event["limit_value"] is not None and newer(at, "named_at"):
                    slot |= {"named": number, "named_at": at}
                if event["left_value"] is not None and newer(at, "left_at"):
                    slot |= {"left": int(event["left_value"]), "left_day": day, "left_at": at}
            elif event["daily"]:
                slot["spent"] = max(slot["spent"] or day, day)
                if number and newer(at, "named_at"):
                    slot |= {"named": number, "named_at": at}
                elif not number and newer(at, "guess_at"):
                    slot |= {"guess": max(1, self._count(day)), "guess_at": at}
            elif number and newer(at, "minute_at"):
                slot |= {"minute": number, "minute_at": at}
        for day in sorted((d for (d,) in self.requests.keys()), reverse=True)[self.days :]:
            self.requests.removeKey((day,))
        self.slot.update(tuple(slot[name] for name in self.names))
        today, day = self._count(slot["day"]), slot["day"]
        limit = slot["guess"] if slot["named"] is None else slot["named"]
        source = "server" if slot["named"] is not None else "estimate" if slot["guess"] is not None else None
        left = slot["left"] if slot["left_day"] == day else max(0, limit - today) if limit else None
        spent = slot["spent"] == day
        row = (*key, slot["at"], day, today, limit, source, slot["minute"], 0 if spent else left, spent)
        yield pd.DataFrame([row], columns=[field.split()[0] for field in USAGE_SCHEMA.split(", ")]).astype({"limit_day": "Int32", "limit_minute": "Int32", "left": "Int32"})


def key_limits(events: DataFrame, days: int = 8) -> DataFrame:
    """What ``logs.key_usage`` says of each key and model as of its last event, after each batch that has any (update mode):
    requests of that quota day, limits of days and minutes apart, and what is left. An estimate never replaces a number that
    a server named. State is some numbers a key and model, and the counts of its last ``days`` days."""
    turn = F.when(F.col("kind") == "success", 0).when(F.col("kind") == "server_counts", 1).otherwise(2)
    rows = events.select(
        "provider", "key_id", "model", "kind", F.coalesce("daily", F.lit(False)).alias("daily"), "limit_value", "left_value", "at",
        text.quota_day(F.col("at"), F.col("provider")).cast("string").alias("day"), turn.alias("turn"),
    )
    return rows.groupBy("provider", "key_id", "model").transformWithStateInPandas(Usage(days), USAGE_SCHEMA, "Update", "none")
