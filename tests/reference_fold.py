"""Sequential forms of the chain and cursor rules, for small fixtures only."""

import hashlib
import io
import json
import random

SCHEMA = "evledger.event.v1"


def digest(event):
    body = {k: v for k, v in event.items() if k != "content_hash"}
    text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def event(i, previous, source="a", project="p", event_type="t"):
    e = {
        "schema": SCHEMA,
        "event_id": f"evt_{i:04d}",
        "ts": "2024-01-01T00:00:00Z",
        "source": source,
        "event_type": event_type,
        "project": project,
        "cwd": "/w",
        "summary": f"s{i}",
        "raw_text": f"text é {i} " + "x" * (i % 37),
        "tags": ["t"],
        "artifacts": [],
        "payload": {"n": i, "f": 1.5},
        "privacy": {"scope": "local_only", "review_required": True},
        "previous_hash": previous,
    }
    e["content_hash"] = digest(e)
    return e


def dump(e):
    return json.dumps(e, ensure_ascii=False, sort_keys=True).encode() + b"\n"


def chain(n, sources=("a", "b", "c")):
    out, previous = [], None
    for i in range(n):
        e = event(i, previous, source=sources[i % len(sources)])
        previous = e["content_hash"]
        out.append(e)
    return out


def lines_of(data):
    at = 0
    for number, raw in enumerate(io.BytesIO(data), 1):
        yield number, at, raw
        at += len(raw)


def read(data, offset=0, last_id=None, last_hash=None, sources=None, limit=None, max_bytes=1 << 30, known=()):
    """Batch rules step by step; returns (ids, offset, id, hash, chain, cursor, truncated)."""
    size, start = len(data), offset
    if offset > size:
        return [], 0, None, None, "not_checked", "truncated", False
    if offset > 0:
        if not last_id or not last_hash:
            return [], 0, None, None, "failed", "invalid", False
        before = [raw for _, at, raw in lines_of(data) if at < offset and raw.strip(b"\r\n")]
        try:
            edge = json.loads(before[-1])
        except (ValueError, IndexError):
            edge = {}
        if edge.get("event_id") != last_id or edge.get("content_hash") != last_hash:
            return [], 0, None, None, "failed", "invalid", False
    if limit == 0 or offset == size:
        return [], offset, last_id, last_hash, "verified" if offset == 0 else "partial", "ok", False
    expected, picked, crossed, failed, early = last_hash, [], False, False, False
    for _, at, raw in lines_of(data):
        if at < start:
            continue
        budget = max_bytes - (offset - start)
        if budget <= 0 or len(raw) > budget or not raw.endswith(b"\n"):
            early = True
            break
        if not raw.strip():
            offset += len(raw)
            continue
        try:
            e = json.loads(raw.decode())
            assert isinstance(e, dict)
        except (ValueError, AssertionError):
            failed = True
            break
        if e.get("content_hash") != digest(e):
            failed = True
            break
        if e.get("previous_hash") != expected:
            if at not in known:
                failed = True
                break
            crossed = True
        offset += len(raw)
        expected = last_hash = e["content_hash"]
        last_id = e["event_id"]
        if sources is None or e["source"] in sources:
            picked.append(e["event_id"])
            if limit is not None and len(picked) >= limit:
                early = offset < size
                break
    status = (
        "failed" if failed else "partial" if crossed else "verified" if start == 0 and offset == size else "partial"
    )
    return picked, offset, last_id, last_hash, status, "invalid" if failed else "ok", early


def damage(rng: random.Random, data: bytes) -> bytes:
    """One random fault in ledger bytes."""
    rows = data.splitlines(keepends=True)
    i = rng.randrange(len(rows))
    kind = rng.choice(["none", "flip", "drop", "swap", "copy", "junk", "blank", "cut", "list"])
    if kind == "flip":
        rows[i] = rows[i].replace(b"text", b"tent", 1)
    elif kind == "drop":
        del rows[i]
    elif kind == "swap" and i:
        rows[i - 1], rows[i] = rows[i], rows[i - 1]
    elif kind == "copy":
        rows.insert(i, rows[i])
    elif kind == "junk":
        rows.insert(i, b"{broken\n")
    elif kind == "blank":
        rows.insert(i, rng.choice([b"\n", b"\r\n"]))
    elif kind == "list":
        rows.insert(i, b"[1, 2]\n")
    out = b"".join(rows)
    return out[:-1] if kind == "cut" and out else out
