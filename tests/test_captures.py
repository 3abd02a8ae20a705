"""Rules of capture records and proposals, one broken at a time."""

import hashlib
import json

from textloom.operators import captures as C
from textloom.operators import sections as S

CID = "cap-20240101-120000-ab12"
SHA = hashlib.sha256(b"words\n").hexdigest()


def record(change=(), drop=(), sections=(), events="- t | state:processing | x\n", extra=""):
    fields = dict.fromkeys(S.FIELDS[:20], "null") | {"id": CID, "type": "capture", "title": "t", "status": "processing", "capture_kind": "text", "capture_channel": "mcp", "language_hint": "fa", "sha256": SHA, "bytes": "6", "schema_version": "1.0.0"} | dict(change)
    parts = dict.fromkeys(S.SECTIONS, "\n") | {S.SECTIONS[0]: "words\n", S.SECTIONS[4]: events} | dict(sections)
    head = "".join(f"{k}: {v}\n" for k, v in fields.items() if k not in drop)
    return f"---\n{head}{extra}---\n" + "".join(f"\n## {n}\n\n{c}" for n, c in parts.items() if n not in drop)


def found(spark, cases, media=()):
    rows = [(f"{k}/{CID}.md", t) for k, t in cases.items()]
    files = spark.createDataFrame(list(media), "path string, sha256 string, bytes long")
    out = {k: [] for k in cases}
    for r in C.problems(spark.createDataFrame(rows, "path string, text string"), files).collect():
        out[r.path.split("/")[0]].append(f"{r.code} {r.detail}".strip())
    return {k: sorted(v) for k, v in out.items()}


def test_rules_of_records(spark):
    cases = {
        "good": record(), "id": record({"id": "cap-1"}), "type": record({"type": "note"}), "state": record({"status": "lost"}), "schema": record({"schema_version": "2"}), "hash": record({"sha256": "AB"}), "none": "text", "null": None,
        "twice": record(sections={"Review notes": "\n## Review notes\n\n"}), "field": record(drop=("bytes",)), "part": record(drop=("Review notes",)), "step": record({"status": "promoted"}, events="- | state:reviewed | \n- | state:processing | \n- | state:promoted | \n"),
        "needs": record(extra="interpretation_needs: [needs_description, more]\n"), "needy": record(extra="interpretation_needs: [needs_description]\n"), "method": record(extra="derivative_methods: [literal:x, 5]\n"),
        "tier": record(extra="derivative_tier: gold\n"), "claimed": record(extra="derivative_methods: [literal:claude]\n"), "fine": record(extra="derivative_methods: [interpretation:claude]\nderivative_tier: candidate\n", sections={S.OPTIONAL[0]: "said\n"}), "unsaid": record(sections={S.OPTIONAL[0]: "said\n"}),
    }
    assert found(spark, cases) == {
        "good": [], "id": ["E_BAD_ID", "E_FILENAME_MISMATCH"], "type": ["E_BAD_TYPE"], "state": ["E_BAD_STATE lost", "E_STATE_DIVERGED processing"], "schema": ["E_BAD_SCHEMA"], "hash": ["E_BAD_HASH", "E_HASH_MISMATCH text"], "none": ["E_BAD_RECORD no_front_matter"], "null": ["E_BAD_RECORD null"],
        "twice": ["E_AMBIGUOUS_BODY out of order", "E_AMBIGUOUS_BODY twice: Review notes"], "field": ["E_MISSING_FIELD bytes"], "part": ["E_MISSING_SECTION Review notes"], "step": ["E_BAD_TRANSITION reviewed -> processing"],
        "needs": ["E_BAD_NEEDS"], "needy": [], "method": ["E_BAD_DERIVATIVE_METHOD"], "tier": ["E_BAD_TIER gold"], "claimed": ["E_BAD_TIER method"], "fine": [], "unsaid": ["E_UNATTRIBUTED_DERIVATIVE"],
    }


def test_media_of_records(spark):
    voice = lambda **more: record({"capture_kind": "voice", "raw_media": "media/a.ogg"} | more)
    cases = {
        "good": voice(), "mixed": voice(capture_kind="mixed"), "drawn": voice(capture_kind="drawing", raw_media="media/b.PNG"), "kind": voice(capture_kind="image"), "up": voice(raw_media="../a.ogg"), "root": voice(raw_media="/a.ogg"),
        "gone": voice(raw_media="media/c.ogg"), "size": voice(bytes="7"), "hash": voice(sha256="a" * 64),
    }
    media = [("media/a.ogg", SHA, 6), ("media/b.PNG", SHA, 6)]
    assert found(spark, cases, media) == {
        "good": [], "mixed": [], "drawn": [], "kind": ["E_MEDIA_MISMATCH image"], "up": ["E_TRAVERSAL raw_media"], "root": ["E_TRAVERSAL raw_media"], "gone": ["E_MEDIA_MISSING media/c.ogg"], "size": ["E_SIZE_MISMATCH"], "hash": ["E_HASH_MISMATCH media"],
    }


def test_rules_of_proposals(spark):
    kinds = {"claim": ("statement", "source_passage"), "tier-change": ("to_tier",), "intake-registration": ("original_path", "sha256")}
    quote = "a quote of twenty letters"
    cases = {
        "good": ("claim", {"statement": 1, "source_passage": {"path": " p ", "quote": quote}}), "path": ("claim", {"statement": None, "source_passage": "p"}), "quote": ("claim", {"statement": 1, "source_passage": {"path": "p", "quote": quote + "!"}}),
        "nopath": ("claim", {"statement": 1, "source_passage": {"quote": quote}}), "away": ("claim", {"statement": 1, "source_passage": {"path": "x", "quote": quote}}), "none": ("claim", {}), "kind": ("dream", {}), "tier": ("tier-change", {"to_tier": "x"}), "gold": ("tier-change", {"to_tier": "gold"}),
        "intake": ("intake-registration", {"original_path": "p", "sha256": "a" * 64}), "lost": ("intake-registration", {"original_path": "x", "sha256": "a" * 63}),
    }
    rows = [(k, kind, json.dumps(b)) for k, (kind, b) in cases.items()] + [("list", "claim", "[]"), ("null", "claim", None)]
    passages = spark.createDataFrame([("p", f"here is {quote}.")], "path string, text string")
    got = {k: [] for k, _, _ in rows}
    for r in C.proposal_problems(spark.createDataFrame(rows, "id string, kind string, body string"), passages, kinds, ("gold",)).collect():
        got[r.id].append(r.problem)
    assert {k: sorted(v) for k, v in got.items()} == {
        "good": [], "path": ["quote_short"], "quote": ["quote_not_found"], "nopath": ["path_missing"], "away": ["path_unknown"], "none": ["missing: statement", "passage_missing"], "kind": ["unknown_kind"], "tier": ["bad_tier"], "gold": [], "intake": [], "lost": ["bad_hash", "original_unknown"],
        "list": ["no_object"], "null": ["no_object"],
    }
