"""Deeply nested records to flat, linked tables in one pass.

A depth-first visitor walks every payload once and emits *tagged* rows
``(tag, pk, parent_pk, payload)``: the tag names the target table, the keys keep the parent-child link,
the payload is a small JSON object with exactly the fields of that table.  The tagged rows are written
once, partitioned by tag, and each table is then read from its own partition under its own schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.storage import Workspace

TAGGED_SCHEMA = "tag string, delivery_id bigint, pk string, parent_pk string, payload string"

#: Fields of each flat table, in the order of its columns.
TABLES: dict[str, str] = {
    "finding": "record_no int, finding_id string, status string, known_gaps array<string>",
    "model": "model_no int, finding_id string, name string, execution_mode string, source_url_or_repo string",
    "checkpoint": (
        "model_no int, finding_id string, execution_mode string, position int, checkpoint_path string, depth int, "
        "filename string, source_url_or_repo string, bytes_reported string"
    ),
    "checksum": "checksum_no int, kind string, value string",
    "source": "role string, source_no int, finding_id string, name string, source_url_or_repo string, rows_or_units string",
    "reject": "reason string",
}


#: Rows that one emitted frame holds.
FRAME_ROWS = 20_000

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_LITERALS = {"true": True, "false": False, "null": None}


class Number(str):
    """A JSON number as it was written."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _read_deep(text: str) -> Any:
    """A JSON text of any depth, read with a stack of its own; ``ValueError`` if it is none."""
    root: list = []
    stack: list = [root]  # the containers that are open; a key that waits for its value stands in ``keys``
    keys: list = [None]
    at = _BLANK.match(text).end()
    while True:
        # one value
        c = text[at : at + 1]
        opened = False
        if c == "{" or c == "[":
            value: Any = {} if c == "{" else []
            at += 1
            opened = True
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            word = next((w for w in _LITERALS if text.startswith(w, at)), None)
            if word:
                value, at = _LITERALS[word], at + len(word)
            else:
                number = _NUMBER.match(text, at)
                if not number:
                    raise ValueError("no value")
                value, at = Number(number.group()), number.end()
        top = stack[-1]
        if isinstance(top, list):
            top.append(value)
        else:
            top[keys[-1]] = value
        if opened:
            stack.append(value)
            keys.append(None)
        # what follows it, up to the start of the next value
        while True:
            at = _BLANK.match(text, at).end()
            top = stack[-1]
            if top is root:
                if at != len(text):
                    raise ValueError("text after the value")
                return root[0]
            c = text[at : at + 1]
            if c == ("]" if isinstance(top, list) else "}"):
                stack.pop()
                keys.pop()
                at += 1
                opened = False
                continue
            if not opened:
                if c != ",":
                    raise ValueError("no comma")
                at = _BLANK.match(text, at + 1).end()
            if isinstance(top, dict):
                if text[at : at + 1] != '"':
                    raise ValueError("no key")
                keys[-1], at = scanstring(text, at + 1, True)
                at = _BLANK.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("no colon")
                at = _BLANK.match(text, at + 1).end()
            break


def read_json(text: str) -> Any:
    """A JSON text; numbers stay as written.  Texts nested deeper than the library's reader allows are read by :func:`_read_deep`."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=Number, parse_float=Number)
    except RecursionError:
        return _read_deep(text)


def _open(value: Any) -> Any:
    """A text that is itself a JSON object or list is read as such, again and again; the rest is as it is."""
    while isinstance(value, str) and not isinstance(value, Number):
        text = value.strip()
        if not text or text[0] not in "{[":
            return value
        try:
            inner = read_json(text)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list)):
            return value
        value = inner
    return value


def _entries(value: Any) -> list[tuple[int, Any]]:
    """Entries of a list with their positions; a single value counts as a list of one, null entries keep their place."""
    value = _open(value)
    if value is None:
        return []
    items = value if isinstance(value, list) else [value]
    return [(i, x) for i, x in ((i, _open(x)) for i, x in enumerate(items)) if x is not None]


def _text(value: Any) -> str | None:
    """A scalar as it was written; objects and lists, of any depth, as JSON."""
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    out: list[str] = []
    stack: list = [value]  # values, and marks of text to write as it is
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):
            out.append(v[0])
        elif isinstance(v, dict):
            parts: list = []
            for k, x in v.items():
                parts += [(", ",) if parts else ("",), (json.dumps(k, ensure_ascii=False) + ": ",), x]
            stack += [("}",), *reversed(parts), ("{",)]
        elif isinstance(v, list):
            parts = []
            for x in v:
                parts += [(", ",) if parts else ("",), x]
            stack += [("]",), *reversed(parts), ("[",)]
        else:
            out.append(str(v) if isinstance(v, Number) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _dump(**fields: Any) -> str:
    return json.dumps(fields, ensure_ascii=False)


def visit(payload: str | None) -> Iterator[tuple[str, str, str | None, str]]:
    """Depth-first visit of one payload: ``(tag, pk, parent_pk, payload)`` below the delivery.

    Null, empty, cut-off or otherwise invalid payloads give one ``reject`` row; valid JSON without
    records gives nothing.  Reader and walk keep their own stacks, so payloads may be nested to any depth.
    Checkpoints are numbered within their model in the order of the visit.  ``position`` is a checkpoint's
    own place; ``checkpoint_path``, all places from the model on, is written for checkpoints with a source
    of their own only, as a chain of n checkpoints has paths of n^2 / 2 places in all.
    """
    if payload is None or not payload.strip():
        yield "reject", "0", None, _dump(reason="empty")
        return
    try:
        root = _open(read_json(payload))
    except ValueError:
        yield "reject", "0", None, _dump(reason="invalid")
        return
    if not isinstance(root, dict):
        return
    for record_no, record in _entries(root.get("provenance")):
        if not isinstance(record, dict):
            continue
        finding = f"f{record_no}"
        finding_id = _text(record.get("finding_id"))
        gaps = [_text(x) for _, x in _entries(record.get("known_gaps"))]
        yield (
            "finding",
            finding,
            None,
            _dump(record_no=record_no, finding_id=finding_id, status=_text(record.get("status")), known_gaps=gaps),
        )
        for role in ("dataset_sources", "metadata_sources"):
            for no, source in _entries(record.get(role)):
                fields = source if isinstance(source, dict) else {"source_url_or_repo": source}
                yield (
                    "source",
                    f"{finding}/{role[0]}{no}",
                    finding,
                    _dump(
                        role=role,
                        source_no=no,
                        finding_id=finding_id,
                        name=_text(fields.get("name")),
                        source_url_or_repo=_text(fields.get("source_url_or_repo")),
                        rows_or_units=_text(fields.get("rows_or_units")),
                    ),
                )
        for model_no, model in _entries(record.get("model_source")):
            if not isinstance(model, dict):
                continue
            model_pk = f"{finding}/m{model_no}"
            mode = _text(model.get("execution_mode")) or ""
            yield (
                "model",
                model_pk,
                finding,
                _dump(
                    model_no=model_no,
                    finding_id=finding_id,
                    name=_text(model.get("name")),
                    execution_mode=mode,
                    source_url_or_repo=_text(model.get("source_url_or_repo")),
                ),
            )
            # (parent key, place in the tree as (places above, own place, depth), entry)
            stack = [(model_pk, (None, no, 1), entry) for no, entry in reversed(_entries(model.get("weights_or_checkpoint")))]
            number = 0
            while stack:
                parent, place, entry = stack.pop()
                if isinstance(entry, list):  # a list inside a list: its entries stand one step deeper
                    stack.extend((parent, (place, i, place[2] + 1), x) for i, x in reversed(_entries(entry)))
                    continue
                here = f"{model_pk}/c{number}"
                number += 1
                fields = entry if isinstance(entry, dict) else {"source_url_or_repo": entry}
                source = _text(fields.get("source_url_or_repo"))
                yield (
                    "checkpoint",
                    here,
                    parent,
                    _dump(
                        model_no=model_no,
                        finding_id=finding_id,
                        execution_mode=mode,
                        position=place[1],
                        checkpoint_path=_path(place) if source else None,
                        depth=place[2],
                        filename=_text(fields.get("filename")),
                        source_url_or_repo=source,
                        bytes_reported=_text(fields.get("bytes_reported")),
                    ),
                )
                for i, check in _entries(fields.get("checksums")):
                    if isinstance(check, dict):
                        yield "checksum", f"{here}/h{i}", here, _dump(checksum_no=i, kind=_text(check.get("kind")), value=_text(check.get("value")))
                stack.extend((here, (place, i, place[2] + 1), x) for i, x in reversed(_entries(fields.get("derived_from"))))


def _path(place: tuple) -> str:
    parts = []
    while place is not None:
        parts.append(str(place[1]))
        place = place[0]
    return ".".join(reversed(parts))


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for delivery, payload in zip(batch["delivery_id"], batch["payload"]):
            key = None if pd.isna(delivery) else int(delivery)
            # one delivery id may come with several payloads: the key names both
            mark = "" if payload is None else blake2b(payload.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            prefix = f"{'' if key is None else key}:{mark}:"
            for tag, pk, parent, body in visit(payload):
                rows.append((tag, key, prefix + pk, prefix + parent if parent else None, body))
                if len(rows) >= FRAME_ROWS:
                    yield _frame(rows)
                    rows = []
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["tag", "delivery_id", "pk", "parent_pk", "payload"])
    out["delivery_id"] = out["delivery_id"].astype("Int64")
    return out


def tagged_rows(deliveries: DataFrame, id_col: str = "delivery_id", payload_col: str = "payload") -> DataFrame:
    """The single pass: every delivery's tagged rows.  Deliveries repeated word for word are visited once."""
    slim = deliveries.select(F.col(id_col).cast("bigint").alias("delivery_id"), F.col(payload_col).cast("string").alias("payload"))
    return slim.dropDuplicates().mapInPandas(_emit, TAGGED_SCHEMA)


def flatten(deliveries: DataFrame, workspace: Workspace, id_col: str = "delivery_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """All flat tables of :data:`TABLES`.

    Each has ``delivery_id, pk, parent_pk`` and its own columns; ``pk``, made of the delivery, a hash of the
    payload and the place in it, is unique in its table and ``parent_pk`` is the ``pk`` of the row above
    (findings have none).  The payloads are parsed once; reading one table touches only its partition of the
    tagged rows.  An empty input gives empty tables; extra input columns are ignored; if one delivery comes
    with two different payloads, the rows of both are kept, under keys of their own.
    """
    tagged = workspace.save(tagged_rows(deliveries, id_col, payload_col), "tagged", ["tag"])
    out = {}
    for tag, schema in TABLES.items():
        body = F.from_json("payload", schema)
        out[tag] = tagged.where(F.col("tag") == tag).select("delivery_id", "pk", "parent_pk", body.alias("r")).select("delivery_id", "pk", "parent_pk", "r.*")
    return out


def checkpoint_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """Checkpoints with a non-blank source of their own, with the keys of their model and finding."""
    found = tables["checkpoint"].where(F.length(F.regexp_replace("source_url_or_repo", r"^[\s\p{Z}]+$", "")) > 0)
    return found.select("delivery_id", "finding_id", "model_no", "execution_mode", "checkpoint_path", "source_url_or_repo").distinct()
