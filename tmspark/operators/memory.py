"""Translation memory: latest entries, exact and fuzzy retrieval, edits, imports, usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmspark.functions import helpers, text


def phrase_key(source: Column) -> Column:
    """The normalised line; the raw line where nothing is left of it."""
    key = text.normalize_phrase(source)
    return F.when(key == "", source).otherwise(key)


def latest_per_source(corrections: DataFrame) -> DataFrame:
    """The newest entry (largest id) of each project and phrase key, with ``phrase_key``."""
    keyed = corrections.withColumn("phrase_key", phrase_key(F.col("source_text")))
    row = F.max_by(F.struct(*[F.col(c) for c in keyed.columns]), "id").alias("_r")
    return keyed.groupBy("project_id", "phrase_key").agg(row, F.min("id").alias("first_id")).select("_r.*", "first_id")


def tm_exact(queries: DataFrame, corrections: DataFrame, max_words: int = 2) -> DataFrame:
    """Short queries (query_id, project_id, text) with the latest entry of an equal, non-empty phrase key."""
    asked = queries.where(text.is_short_phrase(F.col("text"), max_words)).withColumn("phrase_key", text.normalize_phrase(F.col("text")))
    held = latest_per_source(corrections).where(text.normalize_phrase(F.col("source_text")) != "")
    return asked.where("phrase_key <> ''").join(
        held.select("project_id", "phrase_key", F.col("id").alias("correction_id"), "final_translation"), ["project_id", "phrase_key"]
    ).select("query_id", "project_id", "correction_id", "final_translation", F.lit(1.0).alias("similarity"))


def by_blocks(queries: DataFrame, memory: DataFrame, asked: list[str], held: list[str], multiply: Callable, schema: str, block_rows: int = 20_000, query_rows: int = 20_000) -> DataFrame:
    """``multiply`` over each block of a project's queries (query_id, embedding, and ``asked``) with each block of its
    memory (id, embedding, and ``held``).

    The memory of a project is dealt to blocks by a hash, so that a large project is many tasks; queries go to each of
    their project's blocks in blocks of their own."""
    sizes = memory.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    amounts = queries.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_parts"))
    both = sizes.join(amounts, "project_id")
    m = memory.join(both, "project_id").select(
        "project_id", F.col("id").alias("_id"), F.col("embedding").alias("_e"), *held, F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("_b"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"),
    )
    q = queries.join(both, "project_id").select(
        "project_id", F.col("query_id").alias("_id"), F.col("embedding").alias("_e"), *asked,
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"), F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int").alias("_p"),
    )

    names = [field.split()[0] for field in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            b = np.array(right["_e"].tolist(), dtype=np.float64).T
            for a in range(0, len(left), 256):
                part = left.iloc[a : a + 256]
                out.append(multiply(part, right, np.array(part["_e"].tolist(), dtype=np.float64) @ b))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    by = ["project_id", "_b", "_p"]
    return q.groupBy(*by).cogroup(m.groupBy(*by)).applyInPandas(run, schema)


def candidate_pairs(queries: DataFrame, memory: DataFrame, threshold: float, **sizes) -> DataFrame:
    """Every pair (query_id, correction_id, similarity) of one project with a cosine of the threshold or more."""

    def multiply(asked: pd.DataFrame, held: pd.DataFrame, product: np.ndarray) -> pd.DataFrame:
        q, m = np.nonzero(product >= threshold)
        return pd.DataFrame({"query_id": asked["_id"].to_numpy()[q], "correction_id": held["_id"].to_numpy()[m], "similarity": product[q, m]})

    return by_blocks(queries, memory, [], [], multiply, "query_id long, correction_id long, similarity double", **sizes)


def best_similarities(queries: DataFrame, memory: DataFrame, **sizes) -> DataFrame:
    """(query_id, best, correction_id): the highest cosine of each query in its project, whatever it is, and the entry that
    has it (of equal ones the one with the smallest first_id)."""

    def multiply(asked: pd.DataFrame, held: pd.DataFrame, product: np.ndarray) -> pd.DataFrame:
        order = np.argsort(held["first_id"].to_numpy(), kind="stable")
        top = order[product[:, order].argmax(axis=1)]
        found = {"best": product[np.arange(len(top)), top], "first_id": held["first_id"].to_numpy()[top], "correction_id": held["_id"].to_numpy()[top]}
        return pd.DataFrame({"query_id": asked["_id"].to_numpy(), **found})

    each = by_blocks(queries, memory, [], ["first_id"], multiply, "query_id long, best double, first_id long, correction_id long", **sizes)
    top = F.max(F.struct("best", -F.col("first_id"), "correction_id")).alias("_b")
    return each.groupBy("query_id").agg(top).select("query_id", "_b.best", "_b.correction_id")


def block_examples(queries: DataFrame, memory: DataFrame, threshold: float, k: int, lexical_min: float = 0.0, strong: float = 0.0, **sizes) -> DataFrame:
    """(query_id, correction_id, similarity, overlap, score): of each query and block of the memory (id, first_id,
    final_translation, kind, source_text, embedding) the k best examples of different final texts.

    The best k of all blocks together are among these, so no more than k pairs a query leave a block. Entries are gone
    through from the best, and the gate is asked only of those that come up. Without a gate (``lexical_min`` 0) no words are
    looked at, and ``overlap`` is 0."""
    none = F.array().cast("array<bigint>")
    hashed = lambda c: F.transform(text.content_words(F.col(c)), lambda w: F.xxhash64(w)) if lexical_min > 0 else none
    m = memory.select(
        "project_id", "id", "embedding", "first_id", (F.coalesce("kind", F.lit("corrected")) == "corrected").alias("_edited"),
        F.xxhash64(F.lower(F.trim("final_translation"))).alias("_final"), hashed("source_text").alias("_mw"),
    )
    q = queries.withColumn("_qw", hashed("text"))

    def multiply(asked: pd.DataFrame, held: pd.DataFrame, product: np.ndarray) -> pd.DataFrame:
        ids, first, final = (held[c].to_numpy() for c in ("_id", "first_id", "_final"))
        score = product + np.where(held["_edited"].to_numpy(), 0.02, 0.0)
        words, rows = held["_mw"].tolist(), []
        for n, (query, own) in enumerate(zip(asked["_id"], asked["_qw"], strict=True)):
            at = np.flatnonzero(product[n] >= threshold)
            own, seen = set(own), set()
            for j in at[np.lexsort((first[at], -score[n, at]))]:
                if final[j] in seen:
                    continue
                other = set(words[j])
                overlap = 100.0 * len(own & other) / len(own | other) if own and other else 0.0
                if product[n, j] < strong and lexical_min > 0 and overlap < lexical_min:
                    continue
                seen.add(final[j])
                rows.append((query, ids[j], product[n, j], overlap, score[n, j]))
                if len(seen) == k:
                    break
        return pd.DataFrame(rows, columns=["query_id", "correction_id", "similarity", "overlap", "score"])

    schema = "query_id long, correction_id long, similarity double, overlap double, score double"
    return by_blocks(q, m, ["_qw"], ["first_id", "_edited", "_final", "_mw"], multiply, schema, **sizes)


def top_examples(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best rows (score desc, first_id asc) of each query, one for each lower-cased final text."""
    final = F.lower(F.trim("final_translation"))
    order = [F.desc("score"), F.asc("first_id")]
    once = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", final).orderBy(*order))).where("_n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).drop("_n")


def tm_fuzzy(
    queries: DataFrame, corrections: DataFrame, threshold: float = 0.67, lexical_min: float = 25, strong: float = 0.90, k: int = 3, max_words: int = 2
) -> DataFrame:
    """The best examples of longer queries (query_id, project_id, text, embedding): query_id, rank, correction_id,
    similarity, overlap, final_translation.

    Below ``strong`` an example also needs ``lexical_min`` percent of shared content words; edited entries rank .02
    above accepted ones."""
    asked = queries.where(~text.is_short_phrase(F.col("text"), max_words))
    held = latest_per_source(corrections.where(~text.is_short_phrase(F.col("source_text"), max_words)))
    found = block_examples(asked, held, threshold, k, lexical_min, strong)
    entries = held.select(F.col("id").alias("correction_id"), "first_id", "final_translation")
    return top_examples(found.join(entries, "correction_id"), k).select("query_id", "rank", "correction_id", "similarity", "overlap", "final_translation")


def tm_probe(queries: DataFrame, corrections: DataFrame, max_words: int = 2) -> DataFrame:
    """For each query (query_id, project_id, text, embedding) its lane, how many candidates its project has, the best
    similarity before any gate, and the shared content words (percent) of the entry that has it.

    In the exact lane all entries are candidates and the best is 1 for a hit; in the fuzzy lane they are the latest entries
    of longer lines. Without candidates or a hit the best is null, and so is the overlap outside the fuzzy lane."""
    short = text.is_short_phrase(F.col("text"), max_words)
    held = latest_per_source(corrections.where(~text.is_short_phrase(F.col("source_text"), max_words)))
    amounts = [rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("candidates")) for rows in (corrections, held)]
    hits = tm_exact(queries, corrections, max_words).select("query_id", F.col("similarity").alias("best"), F.lit(None).cast("double").alias("best_overlap"))
    best = best_similarities(queries.where(~short), held).join(held.select(F.col("id").alias("correction_id"), "source_text"), "correction_id")
    best = best.join(queries.select("query_id", "text"), "query_id").select("query_id", "best", text.lexical_overlap(F.col("text"), F.col("source_text")).alias("best_overlap"))
    lanes = [queries.where(c).select("query_id", "project_id", F.lit(lane).alias("lane")).join(n, "project_id", "left").join(found, "query_id", "left")
             for c, lane, n, found in ((short, "exact", amounts[0], hits), (~short, "fuzzy", amounts[1], best))]
    return lanes[0].unionByName(lanes[1]).select("query_id", "lane", F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", "best_overlap")


def edit_final(corrections: DataFrame, edits: DataFrame) -> DataFrame:
    """New final texts (edits: id, new_final, at): the first version is kept once, and an entry that now differs from
    its draft is a corrected one."""
    e = edits.select("id", F.trim("new_final").alias("_new"), F.col("at").alias("_at"))
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("final_translation"))
    differs = F.lower(F.col("_new")) != F.lower(F.trim(F.coalesce("ai_translation", F.lit(""))))
    return corrections.join(e, "id", "left").withColumns(
        {
            "final_before_edit": F.when(changed, F.coalesce("final_before_edit", "final_translation")).otherwise(F.col("final_before_edit")),
            "edited_at": F.when(changed, F.col("_at")).otherwise(F.col("edited_at")),
            "kind": F.when(changed & differs, "corrected").otherwise(F.col("kind")),
            "final_translation": F.when(changed, F.col("_new")).otherwise(F.col("final_translation")),
        }
    ).drop("_new", "_at")


def replace_in_memory(corrections: DataFrame, find: str, new: str, mode: str = "word", ids: DataFrame | None = None) -> DataFrame:
    """Preview (id, source_text, before, after) of a find and replace in final texts; apply it through ``edit_final``."""
    rows = corrections if ids is None else corrections.join(ids.select("id").distinct(), "id", "left_semi")
    likely = rows.where(F.lower("final_translation").contains(find.strip().lower()))  # few rows reach the helper
    after = helpers.replace_terms(find, new, mode)(F.col("final_translation"))
    out = likely.select("id", "source_text", F.col("final_translation").alias("before"), after.alias("after"))
    return out.where("before <> after")


def follow_source_edits(corrections: DataFrame, edits: DataFrame) -> DataFrame:
    """Unused entries of an edited bubble whose key equals the old text's get the new source (edits: page_id, bubble_id,
    old_text, new_text); ``re_embed`` marks them. Letter case doesn't count, nor where capitals write a letter otherwise
    (ß as SS). Edits of one old text are one edit; of several new texts the last in order is taken."""
    key = lambda c: text.normalize_phrase(F.upper(c))
    e = edits.where("new_text is not null").groupBy("page_id", "bubble_id", key("old_text").alias("_old")).agg(F.max("new_text").alias("_new"))
    joined = corrections.withColumn("_old", key("source_text")).join(e, ["page_id", "bubble_id", "_old"], "left")
    hit = (F.coalesce("reuse_count", F.lit(0)) == 0) & F.col("_new").isNotNull()
    rows = joined.withColumns({"re_embed": hit, "source_text": F.when(hit, F.col("_new")).otherwise(F.col("source_text"))})
    return rows.select(*corrections.columns, "re_embed")


def import_corrections(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of a file (seq, source_text, final_translation, ..) to add: not blank, not there already, first in the file."""
    key = [F.col("source_text"), F.lower(F.trim("final_translation"))]
    fresh = incoming.where((F.trim("source_text") != "") & (F.trim("final_translation") != "")).withColumn("_f", key[1])
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("source_text", "_f").orderBy("seq"))).where("_n = 1")
    held = existing.select("source_text", key[1].alias("_f")).distinct()
    return first.join(held, ["source_text", "_f"], "left_anti").drop("_f", "_n")


def export_corrections(corrections: DataFrame, project_id: int) -> DataFrame:
    return corrections.where(F.col("project_id") == project_id).drop("embedding")


def memory_view(corrections: DataFrame, kind: str | None = None, q: str | None = None, sort: str = "newest", locale: str = "pl") -> DataFrame:
    """Entries of a kind that hold a text in source or final, sorted: newest, oldest, most_used, least_used, text_asc,
    text_desc, kind_asc or kind_desc (corrected ones first or last, then by text). Texts are final ones in the order of a
    language, whatever their case; ties go by id, newest first."""
    rows = corrections.withColumn("kind", F.coalesce("kind", F.lit("corrected")))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if q and q.strip():
        found = [F.lower(c).contains(q.strip().lower()) for c in ("source_text", "final_translation")]
        rows = rows.where(found[0] | found[1])
    final, used = F.collate(F.col("final_translation"), f"{locale}_CI_AI"), F.coalesce("reuse_count", F.lit(0))
    accepted = F.col("kind") != "corrected"
    orders = {
        "newest": [F.desc("created_at")], "oldest": [F.asc("created_at")], "most_used": [used.desc()], "least_used": [used.asc()],
        "text_asc": [final.asc()], "text_desc": [final.desc()], "kind_asc": [accepted.asc(), final.asc()], "kind_desc": [accepted.desc(), final.asc()],
    }
    return rows.orderBy(*orders[sort], F.desc("id"))


def correction_usage(corrections: DataFrame, logs: DataFrame) -> DataFrame:
    """Logs in which an entry was injected, with the same bubble's output without memory and the latest final text of
    that source."""
    plain = logs.where("variant = 'zero_shot'").groupBy("run_id", "bubble_id").agg(F.min_by("output_text", "id").alias("without_memory"))
    latest = corrections.groupBy("project_id", "source_text").agg(F.max_by("final_translation", "created_at").alias("latest_final"))
    used = logs.where("variant = 'memory_injected' and matched_correction_id is not null")
    owner = corrections.select(F.col("id").alias("matched_correction_id"), F.col("project_id").alias("_p"))
    return (
        used.join(owner, "matched_correction_id").join(plain, ["run_id", "bubble_id"], "left")
        .join(latest.withColumnRenamed("project_id", "_p"), ["_p", "source_text"], "left")
        .select("matched_correction_id", F.col("id").alias("log_id"), "run_id", "bubble_id", "output_text", "without_memory", "latest_final")
    )


#: Order of events of one phrase: saves and uses in the order they came.
FOLD_SCHEMA = (
    "id long, project_id int, phrase_key string, source_text string, ai_translation string, final_translation string, kind string, "
    "page_id long, bubble_id string, reuse_count int, created_at timestamp"
)


def fold_step(last: dict | None, e: dict, store_approved: bool = False, min_words: int = 3, max_words: int = 2) -> tuple[str | None, dict | None]:
    """What an event does to a phrase's entries, of which only the latest matters: (add, entry), (change, the latest's
    new form), (remove, None), or (None, None).

    A save adds an entry, changes the latest one if that is the same bubble's and unused, removes it if the new text
    isn't worth storing, or does nothing. A use counts on the entry that is the latest then."""
    if e["event"] == "use":
        return (None, None) if last is None else ("change", last | {"reuse_count": last["reuse_count"] + 1})
    final, draft = (e["final_translation"] or "").strip(), (e["ai_translation"] or "").strip()
    same = final.lower() == draft.lower()
    storable = bool(final) and (not same or bool(e["approve"]) and store_approved)
    if final and len((e["source_text"] or "").split()) <= max_words:
        if not e["phrase_key"]:
            return None, None
    elif len(final.split()) < min_words:
        storable = False
    if last is not None and last["final_translation"].strip().lower() == final.lower():
        return None, None
    mine = (
        last is not None and e["page_id"] is not None and bool(e["bubble_id"]) and not last["reuse_count"]
        and (last["page_id"], last["bubble_id"]) == (e["page_id"], e["bubble_id"])
    )
    if not storable:
        return ("remove", None) if mine else (None, None)
    entry = {
        "id": last["id"] if mine else e["seq"], "project_id": e["project_id"], "phrase_key": e["phrase_key"], "source_text": e["source_text"],
        "ai_translation": e["ai_translation"], "final_translation": final, "kind": "approved" if same else "corrected", "page_id": e["page_id"],
        "bubble_id": e["bubble_id"], "reuse_count": 0, "created_at": e["at"],
    }
    return "change" if mine else "add", entry


def fold_phrase(events: list[dict], state: list[dict], **settings) -> list[dict]:
    """The entries of one (project, phrase key) after its events, in order; ``state`` are the entries before."""
    rows = list(state)
    for e in events:
        action, entry = fold_step(rows[-1] if rows else None, e, **settings)
        if action == "add":
            rows.append(entry)
        elif action == "change":
            rows[-1] = entry
        elif action == "remove":
            rows.pop()
    return rows


def closed_entries(rows: list[dict]) -> int:
    """How many of a phrase's first entries no later event can change. Taking the latest away opens the one before it
    again, so all behind the last entry that can't be taken away (used, or of no bubble) must be kept, and that one."""
    lasting = (k for k in range(len(rows) - 1, -1, -1) if rows[k]["reuse_count"] or rows[k]["page_id"] is None or not rows[k]["bubble_id"])
    return next(lasting, 0)


def fold_corrections(saves: DataFrame, **settings) -> DataFrame:
    """The memory that ordered saves and uses leave (see ``fold_step``); ids are the saves' numbers.

    Events are sorted by phrase and number and gone through in batches, whose sizes change no result. Entries that no
    later event can change are given out at once, so what is held of a phrase are its unused entries since the last used
    one."""
    columns = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
    keyed = saves.withColumn("phrase_key", text.normalize_phrase(F.col("source_text")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrase, held = None, []
        for batch in batches:
            rows, done = batch.astype(object).where(lambda x: x.notna(), None).to_dict("records"), []
            for key, events in groupby(rows, key=lambda e: (e["project_id"], e["phrase_key"])):
                if key != phrase:
                    done, phrase, held = done + held, key, []
                held = fold_phrase(list(events), held, **settings)
                closed = closed_entries(held)
                done, held = done + held[:closed], held[closed:]
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(held, columns=columns)

    return keyed.repartition("project_id", "phrase_key").sortWithinPartitions("project_id", "phrase_key", "seq").mapInPandas(fold, FOLD_SCHEMA)


def embed(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], text_col: str = "source_text", out_col: str = "embedding") -> DataFrame:
    """Adds unit vectors of a text column by a model of the user's: ``encode`` takes a list of texts and is called once a
    batch in the tasks; it should load its model on first use. Null texts have null vectors."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.dropna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(known):
                found = np.asarray(encode([" ".join(t.split()) for t in known]), dtype=np.float64)
                norms = np.linalg.norm(found, axis=1, keepdims=True)
                found = (found / np.where(norms > 0, norms, 1)).astype(np.float32)
                out[known.index] = pd.Series(list(found), index=known.index)
            yield out

    return rows.withColumn(out_col, F.pandas_udf(vectors, "array<float>")(F.col(text_col)))


def reembed(corrections: DataFrame, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Entries with new vectors where ``re_embed`` asks for one or none is there; the others are left as they are."""
    wanted = F.coalesce("re_embed", F.lit(False)) | F.col("embedding").isNull()
    done = embed(corrections.withColumn("_t", F.when(wanted, F.col("source_text"))), encode, "_t", "_e")
    return done.withColumn("embedding", F.coalesce("_e", "embedding")).drop("_t", "_e", "re_embed")


def decode_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors stored as little-endian float32 bytes, as arrays."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            yield pd.Series([None if b is None else np.frombuffer(b, dtype="<f4") for b in blobs], dtype=object)

    return rows.withColumn(column, F.pandas_udf(decode, "array<float>")(F.col(column)))
