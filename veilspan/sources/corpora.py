"""Annotated corpora: token columns, nested brackets, mention tables and JSON records, all as sentences with typed spans.

A corpus is (doc_id, sentence, text) and spans (doc_id, sentence, type, start, end); labels that aren't mapped and spans that don't fit their text are counted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import piece
from veilspan.functions.text import normalize_text
from veilspan.operators.windows import spans_of_labels
from veilspan.schema import ENTITY_TYPES

# Labels of the corpora and the types that they stand for.
IOB2_TYPES = {"PER": "person", "ORG": "organization"}
CNEC_PERSON_PARTS = ["pf", "ps", "pm", "p_"]
CNEC_ORGANIZATIONS = ["ic", "if", "io", "i_"]
CNEC_OTHER = {"at": "phone", "me": "email", "mi": "url"}
OPENPII_ID = "openpii-1m"
OPENPII_PERSON = ["GIVENNAME", "SURNAME"]
OPENPII_ADDRESS = ["STREET", "BUILDINGNUM", "ZIPCODE", "CITY"]
OPENPII_ANCHORS = ["STREET", "ZIPCODE"]
OPENPII_TYPES = {"EMAIL": "email"}
OPENPII_GAP = 8
RECORD_TYPES = {
    "Telephone_Numbers_Personal": "phone", "Telephone_Numbers_Work": "phone", "Address_Personal": "address", "Address_Work": "address", "Date_of_Birth": "date",
    "National_Identification_Number": "birth_number", "Passport_Number": "id_number", "Driving_License_Number": "id_number",
}
SKIPPED = "(span not in text)"


def mapped(label: Column, types: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in types.items() for x in pair)), label)


def numbered_sentences(lines: DataFrame) -> DataFrame:
    """(doc_id, sentence, token_no, line): the lines (doc_id, line_no, line) of token files; a blank line ends a sentence."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    blank = F.trim(F.coalesce("line", F.lit(""))) == ""
    counted = lines.withColumn("_blank", blank).withColumn("sentence", F.sum(blank.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where(~F.col("_blank")).withColumn("token_no", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("line_no")) - 1)


def parse_columns(lines: DataFrame, types: dict[str, str] = IOB2_TYPES) -> tuple[DataFrame, DataFrame]:
    """Sentences and spans of two-column IOB2 lines ("token tag"); running it fails on a line without a tag."""
    rows = numbered_sentences(lines)
    split = F.regexp_extract("line", r"(?U)^(.*\S)\s+(\S+)\s*\z", 1), F.regexp_extract("line", r"(?U)^(.*\S)\s+(\S+)\s*\z", 2)
    checked = rows.withColumn("token", F.when(split[0] == "", F.raise_error("a line holds no tag")).otherwise(split[0])).withColumn("tag", split[1])
    return labelled_sentences(checked.select("doc_id", "sentence", "token_no", "token", "tag"), types)


def labelled_sentences(tokens: DataFrame, types: dict[str, str] = IOB2_TYPES) -> tuple[DataFrame, DataFrame]:
    """Sentences and spans of tagged tokens (doc_id, sentence, token_no, token, tag), joined by single spaces. Labels without a type aren't spans."""
    order = Window.partitionBy("doc_id", "sentence").orderBy("token_no")
    placed = tokens.withColumn("start", F.coalesce(F.sum(F.length("token") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    placed = placed.withColumn("end", F.col("start") + F.length("token"))
    sentences = placed.groupBy("doc_id", "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_no", "token"))), lambda x: x["token"]), " ").alias("text"))
    key = F.struct("doc_id", "sentence")
    labels = placed.select(key.alias("doc_id"), F.col("token_no").alias("word"), F.col("tag").alias("label"), F.when(F.col("tag").rlike("^[BI]-"), F.substring("tag", 3, 100)).alias("type"))
    found = spans_of_labels(labels).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.sentence").alias("sentence"), "first", "last", "type")
    at = placed.select("doc_id", "sentence", "token_no", "start", "end")
    spans = found.join(at.select("doc_id", "sentence", F.col("token_no").alias("first"), "start"), ["doc_id", "sentence", "first"]).join(at.select("doc_id", "sentence", F.col("token_no").alias("last"), "end"), ["doc_id", "sentence", "last"])
    return sentences, spans.select("doc_id", "sentence", mapped(F.col("type"), types).alias("type"), F.col("type").alias("label"), "start", "end")


def parse_iob2(lines: DataFrame, types: dict[str, str] = IOB2_TYPES) -> tuple[DataFrame, DataFrame]:
    """Sentences and spans of tab-separated IOB2 lines (id, token, tag, ...) with comments; ``# newdoc`` begins a document."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parted = lines.withColumn("_d", F.sum(F.col("line").startswith("# newdoc").cast("int")).over(order)).withColumn("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("_d").cast("string")))
    rows = numbered_sentences(parted.where(~F.col("line").startswith("#") | (F.trim("line") == "")))
    cells = F.split("line", "\t")
    rows = rows.withColumn("token_no", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("line_no")) - 1)
    return labelled_sentences(rows.select("doc_id", "sentence", "token_no", F.get(cells, 1).alias("token"), F.get(cells, 2).alias("tag")), types)


def placed_tokens(text: Column, tokens: Column) -> Column:
    """Offsets of tokens in a written text, each found after the one before with only white space between; null if one isn't."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"), F.lit(True).alias("good"))

    def step(a: Column, token: Column) -> Column:
        found = F.locate(token, text, 1) if isinstance(token, str) else F.expr("0")
        rest = F.substring(text, a["at"] + 1, F.length(text))
        found = F.instr(rest, token) - 1
        between = F.substring(rest, F.lit(1), found)
        good = a["good"] & (found >= 0) & ~between.rlike(r"(?U)\S")
        start = (a["at"] + found).cast("int")
        return F.struct(F.when(good, start + F.length(token)).otherwise(a["at"]).cast("int").alias("at"), F.when(good, F.concat(a["out"], F.array(start))).otherwise(a["out"]).alias("out"), good.alias("good"))

    done = F.aggregate(tokens, zero, step)
    return F.when(done["good"], done["out"])


_TAG = re.compile(r"<([A-Za-z_?]+) ?")


def parse_brackets(line: str) -> tuple[list[str], list[tuple[str, int, int, tuple[str, ...]]]]:
    """Tokens and spans (tag, first, end, enclosing tags) of a line with nested brackets: ``<`` and a tag open a span, ``>`` closes the innermost one."""
    tokens: list[str] = []
    spans: list[tuple[str, int, int, tuple[str, ...]]] = []
    stack: list[tuple[str, int]] = []
    for part in re.finditer(r"<[A-Za-z_?]+ ?|>|[^\s<>]+|<", line):
        piece_ = part[0]
        if piece_ == ">":
            if not stack:
                raise ValueError("a bracket closes nothing")
            tag, first = stack.pop()
            spans.append((tag, first, len(tokens), tuple(name for name, _ in stack)))
        elif piece_[0] == "<":
            found = _TAG.match(piece_)
            if not found:
                raise ValueError("a bracket has no tag")
            stack.append((found[1], len(tokens)))
        else:
            tokens.append(html.unescape(piece_))
    if stack:
        raise ValueError("a bracket isn't closed")
    return tokens, spans


def bracket_type(tag: str, around: tuple[str, ...]) -> str | None:
    """The type of a bracketed span: whole names and addresses at their outermost, parts of names that stand alone, organisations and contacts."""
    names = ("P", *CNEC_PERSON_PARTS)
    if tag == "P":
        return None if "P" in around else "person"
    if tag in CNEC_PERSON_PARTS:
        return None if any(x in names for x in around) else "person"
    if tag == "A":
        return None if "A" in around else "address"
    return "organization" if tag in CNEC_ORGANIZATIONS else CNEC_OTHER.get(tag)


def parse_cnec(lines: DataFrame) -> DataFrame:
    """(doc_id, sentence, text, spans, unmapped): lines (doc_id, sentence, line) of nested brackets. The stack needs Python, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for line in frame["line"]:
                tokens, found = parse_brackets(line or "")
                starts = [0]
                for token in tokens:
                    starts.append(starts[-1] + len(token) + 1)
                spans, unmapped = [], []
                for tag, first, end, around in found:
                    kind = bracket_type(tag, around)
                    if kind is not None and end > first:
                        spans.append({"type": kind, "start": starts[first], "end": starts[end] - 1})
                    elif kind is None and not ({tag, *around} & {"P", "A", *CNEC_PERSON_PARTS}):
                        unmapped.append(tag)
                rows.append((" ".join(tokens), spans, unmapped))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "sentence": frame["sentence"], "text": [r[0] for r in rows], "spans": [r[1] for r in rows], "unmapped": [r[2] for r in rows]})

    kinds = dict(lines.dtypes)
    return lines.select("doc_id", "sentence", "line").mapInPandas(run, f"doc_id {kinds['doc_id']}, sentence {kinds['sentence']}, text string, spans array<struct<type: string, start: int, end: int>>, unmapped array<string>")


def mentions_by_line(documents: DataFrame, mentions: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, spans and counts of skipped labels: mentions (doc_id, start, end, mention, category) over raw texts (doc_id, text). A range join places mentions on lines."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence", "line"))
    order = Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)).cast("int"))
    joined = mentions.join(documents, "doc_id").withColumn("good", (F.col("end") > F.col("start")) & (piece(F.col("text"), F.col("start"), F.col("end")) == F.col("mention"))).withColumn("type", mapped(F.col("category"), types))
    good = joined.where("good AND type IS NOT NULL").select("doc_id", "type", "start", "end")
    at = lines.alias("l").join(good.alias("m"), "doc_id").where("m.start >= l.line_start AND m.end <= l.line_start + length(l.line)")
    spans = at.select("doc_id", "sentence", "m.type", (F.col("m.start") - F.col("l.line_start")).alias("start"), (F.col("m.end") - F.col("l.line_start")).alias("end"))
    skipped = joined.where("NOT good OR type IS NULL").groupBy("doc_id", F.when(~F.col("good"), SKIPPED).otherwise(F.col("category")).alias("label")).agg(F.count("*").alias("n"))
    return lines.where(F.trim("line") != "").select("doc_id", "sentence", F.col("line").alias("text")), spans, skipped


def record_spans(records: DataFrame, types: dict[str, str] = RECORD_TYPES) -> DataFrame:
    """(doc_id, label, type, start, end): spans of records (doc_id, text, entities array<struct<start, end, entity_string, entity_type>>).

    A span whose offsets don't cut out its own string has the label ``SKIPPED`` and no type; one whose type isn't mapped has no type.
    """
    rows = records.select("doc_id", "text", F.explode("entities").alias("e")).select("doc_id", "text", "e.*")
    good = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (piece(F.col("text"), F.col("start"), F.col("end")) == F.col("entity_string")), F.lit(False))
    label = F.when(good, F.col("entity_type")).otherwise(SKIPPED)
    return rows.select("doc_id", label.alias("label"), F.when(good, mapped(F.col("entity_type"), types)).alias("type"), "start", "end")


def openpii_half(uid: Column) -> Column:
    """``dev`` or ``test``, by the parity of the first byte of a hash of the record's number."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{OPENPII_ID}:"), uid.cast("string")).cast("binary"), 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, "dev").otherwise("test")


def openpii_lines(lines: DataFrame, language: str, half: str | None = None) -> DataFrame:
    """Records (uid, language, source_text, privacy_mask) of JSON lines (value); lines without the language's mark aren't parsed."""
    schema = "uid bigint, language string, source_text string, privacy_mask array<struct<label: string, start: int, end: int, value: string>>"
    marked = lines.where(F.col("value").contains(f'"{language}"')).select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col("language") == language)
    return marked if half is None else marked.where(openpii_half(F.col("uid")) == half)


def openpii_spans(records: DataFrame) -> DataFrame:
    """(uid, type, start, end, labels): runs of adjacent name parts and of adjacent address parts as one span; other labels by themselves.

    Parts of a name join over spaces alone, parts of an address over at most ``OPENPII_GAP`` characters without a line break; an address needs a street or a postcode.
    """
    rows = records.select("uid", "source_text", F.explode("privacy_mask").alias("m")).select("uid", "source_text", "m.label", "m.start", "m.end", "m.value")
    rows = rows.where((F.col("end") > F.col("start")) & (piece(F.col("source_text"), F.col("start"), F.col("end")) == F.col("value")))
    order = Window.partitionBy("uid").orderBy("start", "end")
    label, end = F.lag("label").over(order), F.lag("end").over(order)
    gap = piece(F.col("source_text"), end, F.col("start"))
    names = label.isin(*OPENPII_PERSON) & F.col("label").isin(*OPENPII_PERSON) & gap.rlike(r"(?U)^[^\S\n]*\z")
    places = label.isin(*OPENPII_ADDRESS) & F.col("label").isin(*OPENPII_ADDRESS) & (F.length(gap) <= OPENPII_GAP) & ~gap.contains("\n")
    flagged = rows.withColumn("_new", (~F.coalesce(names | places, F.lit(False))).cast("int"))
    runs = flagged.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("uid", "_run").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.array_sort(F.collect_set("label")).alias("labels"))
    all_in = lambda known: F.forall("labels", lambda x: x.isin(*known))
    kind = F.when(all_in(OPENPII_PERSON), "person").when(all_in(OPENPII_ADDRESS), F.when(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in OPENPII_ANCHORS))), "address")).otherwise(mapped(F.element_at("labels", 1), OPENPII_TYPES))
    return out.select("uid", kind.alias("type"), "start", "end", "labels")


def gold_pages(sentences: DataFrame, spans: DataFrame, per_page: int = 12) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, page_index, text) of sentences, and gold spans in their pages: the outermost of each type."""
    from veilspan.operators.merge import outermost
    from veilspan.sources.layout import paged_sentences

    placed = paged_sentences(sentences, per_page)
    pages = placed.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"]), "\n").alias("text"))
    at = spans.join(placed.select("doc_id", "sentence", "page_index", "offset"), ["doc_id", "sentence"])
    gold = at.select("doc_id", "page_index", "type", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
    return pages, outermost(gold)


def normal_offsets(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with offsets moved to the texts' normal form: an offset is the length of the normal form of what stands before it."""
    joined = spans.join(texts.select("doc_id", "text"), "doc_id")
    moved = lambda c: F.length(normalize_text(F.substring("text", F.lit(1), F.col(c))))
    return joined.withColumn("_s", moved("start")).withColumn("_e", moved("end")).drop("text", "start", "end").withColumnsRenamed({"_s": "start", "_e": "end"})


def without_sample(release: DataFrame, sample: DataFrame) -> DataFrame:
    """A release's records without those of a sample, by text. Running it fails if the sample has a text that the release hasn't."""
    strangers = sample.select("text").distinct().join(release.select("text"), "text", "left_anti").limit(1).withColumn("_bad", F.raise_error("a sample record isn't in the release").cast("int"))
    kept = release.join(sample.select("text"), "text", "left_anti")
    return kept.join(strangers.agg(F.sum("_bad").alias("_bad"))).drop("_bad")


# How planted items and neutral text are marked.
ITEM = r"\[\[([a-z_]+):([^\[\]]+)\]\]"
FILLER = r"\{\{filler:(\d+)\}\}"


def strip_markup(text: Column) -> tuple[Column, Column]:
    """(text, items): a text without the marks of planted items ([[type:text]]), and the items in order as (type, text). Running it fails on marks that are left over."""
    kinds, values = (F.regexp_extract_all(text, F.lit(ITEM), F.lit(k)) for k in (1, 2))
    plain = F.regexp_replace(text, ITEM, "$2")
    checked = F.when(plain.rlike(r"\[\[|\]\]"), F.raise_error("unbalanced item marks")).otherwise(plain)
    known = F.array(*(F.lit(t) for t in ENTITY_TYPES))
    items = F.zip_with(kinds, values, lambda k, v: F.struct(F.when(F.array_contains(known, k), k).otherwise(F.raise_error("an item has an unknown type")).alias("type"), v.alias("text")))
    return checked, items


def benchmark_documents(files: DataFrame, filler_words: list[str]) -> DataFrame:
    """(name, language, kind, part, carrier, text, decoys): the strings of TOML documents (name, content), one row each in the order of their carriers."""
    import tomllib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in frame[["name", "content"]].itertuples(index=False, name=None):
                raw = tomllib.loads(bytes(content).decode())
                parts = [("page", line) for line in raw["lines"]]
                parts += [x for link in raw.get("links", []) for x in (("page", link["anchor"]), ("link", link["target"]))]
                parts += [("metadata", value) for value in raw.get("metadata", {}).values()] + [("bookmark", title) for title in raw.get("bookmarks", [])]
                parts += [x for entry in raw.get("fields", []) for x in (("page", entry["label"]), ("page", entry["value"]), ("form_field", entry["value"]))]
                parts += [("annotation", note[k]) for note in raw.get("annotations", []) for k in ("author", "text")]
                parts += [("embedded_file", item[k]) for item in raw.get("attachments", []) for k in ("filename", "description")] + [("xmp", value) for value in raw.get("xmp", {}).values()]
                for i, (carrier, text) in enumerate(parts):
                    whole = re.sub(FILLER, lambda m: " ".join(filler_words[k % len(filler_words)] for k in range(int(m[1]))), text)
                    rows.append((name, raw["language"], raw["kind"], i, carrier, whole, raw.get("decoys", [])))
            yield pd.DataFrame(rows, columns=["name", "language", "kind", "part", "carrier", "text", "decoys"])

    return files.select("name", "content").mapInPandas(run, "name string, language string, kind string, part int, carrier string, text string, decoys array<string>")


def filler(count: Column, words: list[str]) -> Column:
    """So many neutral words, in turn."""
    pool = F.array(*(F.lit(w) for w in words))
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(pool, i % len(words))), " ")
