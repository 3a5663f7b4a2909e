"""Query planning on the driver: from a text to the branches that are worth running, their texts, weights and limits.

The ontology (label -> aliases) and the registered branches are parameters. Branches without evidence of need or with
weight 0 are dropped before any DataFrame is made; a fuzzy branch runs only where the exact one is empty.
"""

from __future__ import annotations

import concurrent.futures
import hashlib
import json
import re
import time
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from kinolith.functions.text import VIETNAMESE

MAX_DISPLAY, MAX_FUSION, MAX_BRANCH = 10_000, 10_000, 1_000
MAX_ATOMS, MAX_CONCEPTS = 12, 16

#: Words that tell of visible text and of speech. Those under `words` stand alone, the others anywhere.
SIGNALS = {
    "ocr": {"anywhere": ["chữ", "biển hiệu", "bảng hiệu", "logo", "văn bản", "hiển thị", "caption on screen"], "words": ["written", "text", "sign", "subtitle"]},
    "asr": {"anywhere": ["nói", "phát biểu", "lời thoại", "nghe thấy", "âm thanh"], "words": ["said", "says", "speaks", "speech", "audio", "announce", "announces"]},
}
#: Words before a quotation that make it visible text or speech; anywhere in the 60 characters before it.
QUOTE_SIGNALS = {"ocr": ["chữ", "ghi", "biển", "bảng", "logo", "written", "text", "sign"], "asr": ["nói", "phát biểu", "said", "says", "speech", "announce"]}
#: Words of the relations in time.
RELATIONS = {
    "before": {"anywhere": ["trước khi", "trước đó"], "words": ["before"]},
    "after": {"anywhere": ["sau khi", "sau đó"], "words": ["after"]},
    "during": {"anywhere": ["trong khi", "đồng thời"], "words": ["while", "during"]},
    "near": {"anywhere": ["gần đó", "gần lúc"], "words": ["near"]},
    "sequence": {"anywhere": ["lần lượt", "tiếp theo", "sau đó", "rồi"], "words": ["then", "sequence"]},
}
#: Words of the places in a picture, in folded form.
PLACES = {
    "left": ["left", "ben trai", "phia trai"], "right": ["right", "ben phai", "phia phai"], "top": ["top", "above", "phia tren", "ben tren"],
    "bottom": ["bottom", "below", "phia duoi", "ben duoi"], "inside": ["inside", "in", "ben trong", "trong"], "near": ["near", "next to", "gan", "ben canh"],
}
#: Numerals in folded form, one to ten.
NUMERALS = [["one", "mot"], ["two", "hai"], ["three", "ba"], ["four", "bon"], ["five", "nam"], ["six", "sau"], ["seven", "bay"], ["eight", "tam"], ["nine", "chin"], ["ten", "muoi"]]
#: Words that are no concepts.
STOPWORDS = ["một", "những", "các", "đang", "và", "là", "có", "the", "a", "an", "is", "are", "and", "of", "to"]
#: Weights of the atoms of a query.
ATOM_WEIGHTS = {"visual_concept": 0.7, "visible_text": 1.2, "spoken_text": 1.2, "object": 1.0, "temporal": 1.0, "negative": 1.0}
#: Default weights that are not 1 (those of text and speech where they are signalled).
WEIGHTS = {"object": 1.2, "ocr": 1.25, "asr": 1.25}
#: Irregular plurals.
PLURALS = {"person": "people", "mouse": "mice"}

_NUMBER = {w: i + 1 for i, words in enumerate(NUMERALS) for w in words}
_QUOTE = re.compile("[\"“”']([^\"“”']{1,200})[\"“”']")
ALL_BRANCHES = ("clip", "caption", "ocr_lexical", "ocr_semantic", "asr_lexical", "asr_semantic", "object", "temporal")


def fold(text: str) -> str:
    """Without marks, d-stroke as d, ASCII letters and digits only, one blank between them."""
    base = "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKC", base).lower()).strip()


def clean(text: str) -> str:
    """NFKC with single blanks."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def signalled(text: str, signal: dict[str, list[str]]) -> bool:
    low = text.lower()
    return any(w in low for w in signal["anywhere"]) or any(re.search(rf"(?<![a-z0-9_]){re.escape(w)}(?![a-z0-9_])", low) for w in signal["words"])


def language_of(text: str) -> str:
    low = text.lower()
    return "vi" if any(c in VIETNAMESE for c in low) else "en" if re.search("[a-z]", low) else "unknown"


def quotations(text: str, before: list[str] | None = None) -> list[str]:
    """Quoted phrases; with `before`, those with one of the words in the 60 characters in front."""
    return [clean(m[1]) for m in _QUOTE.finditer(text) if before is None or any(w in text[max(0, m.start() - 60) : m.start()].lower() for w in before)]


def variants(text: str, task: str = "kis", frame_query: bool = False) -> list[str]:
    """What is searched: the lines before the first numbered event (trake); scene and question apart (vqa); else the text."""
    if frame_query:
        return ["frame image"]
    if task == "trake":
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        first = next((i for i, x in enumerate(lines) if re.match(r"\d+[.)]", x)), -1)
        return [clean(" ".join(lines[:first]) if first > 0 else text)]
    if task == "vqa":
        parts = [c for p in re.split(r"\r?\n(?:câu hỏi|question)\s*:\s*", text, flags=re.I) if (c := clean(p))]
        return parts if len(parts) > 1 else [clean(text)]
    return [clean(text)]


def plural(label: str) -> str:
    """English plural of a label's last word."""
    if label in PLURALS:
        return PLURALS[label]
    *head, last = label.split(" ")
    ending = f"{last[:-1]}ies" if re.search("[^aeiou]y$", last) else f"{last}es" if re.search("(s|x|z|ch|sh)$", last) else f"{last}s"
    return " ".join([*head, ending])


def alias_order(ontology: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(folded alias, label), longest alias first, then by label; plurals included."""
    pairs = {(fold(a), label) for label, names in ontology.items() for a in [*names, plural(label)]}
    return sorted(pairs, key=lambda x: (-len(x[0]), x[1], x[0]))


@dataclass(frozen=True)
class Objects:
    """What a text says of objects."""

    labels: tuple[str, ...]
    counts: dict[str, int]
    places: tuple[str, ...]
    excluded: tuple[str, ...]


def find_objects(text: str, ontology: dict[str, list[str]]) -> Objects:
    """Labels whose alias is in the text, the number before it, negated ones, and places."""
    padded = f" {fold(text)} "
    labels: dict[str, None] = {}
    counts: dict[str, int] = {}
    excluded: dict[str, None] = {}
    for alias, label in alias_order(ontology):
        if not alias or f" {alias} " not in padded:
            continue
        labels[label] = None
        if m := re.search(rf" (\d+|{'|'.join(_NUMBER)}) {re.escape(alias)} ", padded):
            counts[label] = int(m[1]) if m[1].isdigit() and int(m[1]) else _NUMBER.get(m[1], 1)
        if re.search(rf" (?:khong co|khong|without|no) (?:(?:mot|any) )?{re.escape(alias)} ", padded):
            excluded[label] = None
    places = [p for p, words in PLACES.items() if any(f" {w} " in padded for w in words)]
    return Objects(tuple(x for x in labels if x not in excluded), {k: n for k, n in counts.items() if k not in excluded}, tuple(places), tuple(excluded))


@dataclass(frozen=True)
class Atom:
    """One part of a query's meaning."""

    id: str
    kind: str
    value: str
    weight: float


@dataclass(frozen=True)
class Plan:
    """What to run for a query."""

    text: str
    language: str
    variants: tuple[str, ...]
    concepts: tuple[str, ...]
    atoms: tuple[Atom, ...]
    visible: tuple[str, ...]
    spoken: tuple[str, ...]
    objects: Objects
    relations: tuple[str, ...]
    branches: tuple[str, ...]
    weights: dict[str, float]
    display: int = 100
    fusion: int = 500
    branch: int = 100
    near_ms: int = 1_000
    budget_ms: int = 5_000
    extras: dict = field(default_factory=dict)


def limits(display: int | None = None) -> tuple[int, int, int]:
    """(display, fusion, branch): fusion is never below display; branch follows display once fusion is widened."""
    shown = min(display or 100, MAX_DISPLAY)
    fused = min(max(500, shown), MAX_FUSION)
    return shown, fused, min(max(100, shown if fused > 500 else 1), MAX_BRANCH)


def fan_out(weights: dict[str, float]) -> dict[str, float]:
    """Weights of modalities as weights of branches: one for the picture, one each for text and speech, exact and by meaning."""
    of = {"visual": ["visual", "clip"], "ocr": ["ocr_lexical", "ocr_semantic"], "asr": ["asr_lexical", "asr_semantic"]}
    return {branch: w for name, w in weights.items() for branch in of.get(name, [name])}


def check_request(weights: dict[str, float], budget_ms: int, near_ms: int, frames: Iterable[int] = ()) -> None:
    """Bounds of a request: weights 0..5, budget 10..30,000 ms, window 0..100,000 ms, frames not negative."""
    if bad := {k: w for k, w in weights.items() if not 0 <= w <= 5}:
        raise ValueError(f"weights outside 0..5: {bad}")
    if not 10 <= budget_ms <= 30_000:
        raise ValueError("the budget must be 10 to 30000 ms")
    if not 0 <= near_ms <= 100_000:
        raise ValueError("the window must be 0 to 100000 ms")
    if any(f < 0 for f in frames):
        raise ValueError("frames must not be negative")


def choose_branches(available: Iterable[str], ocr: bool, asr: bool, objects: bool, temporal: bool) -> list[str]:
    """Picture and captions always, the others on their signals; the first available one if none fits."""
    have = list(available)
    wanted = ["clip" if "clip" in have else "visual", "caption"] + ["ocr_lexical", "ocr_semantic"] * ocr + ["asr_lexical", "asr_semantic"] * asr + ["object"] * objects + ["temporal"] * temporal
    return [b for b in wanted if b in have] or have[:1]


def plan_query(
    text: str, ontology: dict[str, list[str]], weights: dict[str, float] | None = None, display: int | None = None, task: str = "kis",
    available: Iterable[str] = ("clip", "caption", "ocr_lexical", "asr_lexical", "object"), budget_ms: int = 5_000, near_ms: int = 1_000,
) -> Plan:
    """Plan of a query; weights are by branch (see `fan_out`)."""
    given = dict(weights or {})
    check_request(given, budget_ms, near_ms)
    main = variants(text, "trake")[0] if task == "trake" else clean(text)
    quoted = quotations(main)
    ocr, asr = signalled(main, SIGNALS["ocr"]) or bool(quoted), signalled(main, SIGNALS["asr"])
    objects = find_objects(main, ontology)
    relations = tuple(k for k, words in RELATIONS.items() if signalled(main, words))
    visible = tuple(quotations(main, QUOTE_SIGNALS["ocr"]) or quoted or [main]) if ocr else ()
    spoken = tuple(quotations(main, QUOTE_SIGNALS["asr"]) or quoted or [main]) if asr else ()
    words = [w for w in re.findall(r"[^\W_]+", main.lower()) if len(w) > 2 and w not in STOPWORDS][:MAX_CONCEPTS]
    concepts = tuple(dict.fromkeys([*objects.labels, *words]))
    parts = {
        "visual_concept": [c for c in concepts if c not in objects.labels][:MAX_ATOMS], "visible_text": visible, "spoken_text": spoken,
        "object": objects.labels, "temporal": relations, "negative": objects.excluded,
    }
    pairs = [(kind, v) for kind, values in parts.items() for v in values]
    atoms = tuple(Atom(f"a{i + 1}", kind, v, ATOM_WEIGHTS[kind]) for i, (kind, v) in enumerate(pairs))
    chosen = choose_branches(available, ocr, asr, bool(objects.labels), bool(relations))
    of = {b: given.get(b, WEIGHTS.get(b.split("_")[0], 1.0)) for b in chosen}
    shown, fused, each = limits(display)
    return Plan(
        main, language_of(main), tuple(variants(text, task)), concepts, atoms, visible, spoken, objects, relations, tuple(b for b in chosen if of[b] > 0), of, shown, fused, each, near_ms, budget_ms
    )


def text_for(plan: Plan, branch: str, ontology: dict[str, list[str]], variant: str | None = None) -> str:
    """The text a branch searches: labels, visible or spoken text, or the variant."""
    if branch == "object":
        own = find_objects(variant, ontology).labels if variant else ()
        return " ".join([x for x in own if x in plan.objects.labels] or plan.objects.labels)
    if branch.startswith("ocr_"):
        return " ".join(plan.visible) or variant or plan.text
    if branch.startswith("asr_") or branch == "audio":
        return " ".join(plan.spoken) or variant or plan.text
    return variant or plan.text


def same_events(original: list[str], rewritten: list[str], overview: str | None, new_overview: str | None) -> str | None:
    """A rewritten event list as text, numbered again; None if the number of events changed or the overview was lost."""
    if len(original) != len(rewritten) or (overview is not None and new_overview is None):
        return None
    return "\n".join(([new_overview] if new_overview is not None else []) + [f"{i}. {e}" for i, e in enumerate(rewritten, 1)])


@dataclass(frozen=True)
class BranchRun:
    """Outcome of a branch: completed, failed, timed_out or unavailable."""

    branch: str
    status: str
    rows: list | None = None
    error: str | None = None
    elapsed_ms: int = 0


def run_branches(spark, searches: dict[str, Callable | None], budget_ms: int) -> list[BranchRun]:
    """Run the branches at once; each returns a DataFrame that is collected under its own job group (bounded by its limit).

    A branch beyond the budget has its jobs cancelled and is timed_out; one that raises is failed and does not end the
    others; one without a search is unavailable."""
    sc = spark.sparkContext
    began = time.monotonic()
    tag = hashlib.sha1(f"{id(searches)}{began}".encode()).hexdigest()[:12]

    def work(name: str) -> list:
        sc.setJobGroup(f"{tag}-{name}", name, interruptOnCancel=True)
        return searches[name]().collect()

    out: dict[str, BranchRun] = {n: BranchRun(n, "unavailable") for n, f in searches.items() if f is None}
    asked = [n for n, f in searches.items() if f is not None]
    pool = concurrent.futures.ThreadPoolExecutor(max(1, len(asked)))
    jobs = {n: pool.submit(work, n) for n in asked}
    for n, job in jobs.items():
        try:
            rows = job.result(max(0.0, budget_ms / 1000 - (time.monotonic() - began)))
            out[n] = BranchRun(n, "completed", rows, None, round((time.monotonic() - began) * 1000))
        except concurrent.futures.TimeoutError:
            sc.cancelJobGroup(f"{tag}-{n}")
            out[n] = BranchRun(n, "timed_out", None, "deadline", budget_ms)
        except Exception as e:  # a branch's failure must not end the others
            out[n] = BranchRun(n, "failed", None, str(e)[:500], round((time.monotonic() - began) * 1000))
    pool.shutdown(wait=False)
    return [out[n] for n in searches]


def closure(needs: dict[str, list[str]], targets: list[str]) -> list[str]:
    """Targets and all they need, in an order that respects the needs (names decide otherwise); a cycle is an error."""
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(n: str) -> None:
        if state.get(n) == 1:
            raise ValueError(f"cycle at {n}")
        if n in state:
            return
        state[n] = 1
        for m in sorted(needs.get(n, [])):
            visit(m)
        state[n] = 2
        order.append(n)

    for t in sorted(targets):
        visit(t)
    return order


def fingerprint(value: object) -> str:
    """SHA-256 of the canonical JSON of a value."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def run_stages(needs: dict[str, list[str]], stages: dict, targets: list[str], done: set[str] | None = None, prints: dict[str, str] | None = None, checkpoint: dict[str, str] | None = None) -> dict[str, str]:
    """Run stages in order; a finished one is skipped, and what needs a failed one is blocked.

    prints: a stage's fingerprint; with a `checkpoint` (stage -> fingerprint of its last finished run, kept by the caller and
    changed here) a stage is skipped only if its fingerprint and those of all it needs are as they were."""
    status: dict[str, str] = {}
    ran: set[str] = set()
    for n in closure(needs, targets):
        mark = fingerprint([(prints or {}).get(n), sorted((m, (checkpoint or {}).get(m)) for m in needs.get(n, []))])
        known = n in (done or ()) or (checkpoint is not None and checkpoint.get(n) == mark and not ran & set(needs.get(n, [])))
        if any(status.get(m) in ("failed", "blocked") for m in needs.get(n, [])):
            status[n] = "blocked"
        elif known:
            status[n] = "skipped"
        else:
            try:
                stages[n]()
                status[n] = "completed"
                ran.add(n)
                if checkpoint is not None:
                    checkpoint[n] = fingerprint([(prints or {}).get(n), sorted((m, checkpoint.get(m)) for m in needs.get(n, []))])
            except Exception as e:  # a stage's failure must not end the others
                status[n] = "failed"
                status[f"{n}.error"] = str(e)[:500]
    return status


def check_config(config: dict, rules: dict[str, tuple[type, Callable[[object], bool]]], graph: dict[str, list[str]] | None = None) -> list[str]:
    """What is wrong with a configuration: unknown, missing or ill values; nodes that need unknown ones; cycles."""
    wrong = [f"unknown: {k}" for k in sorted(set(config) - set(rules))]
    for k, (kind, ok) in rules.items():
        if k not in config:
            wrong.append(f"missing: {k}")
        elif not isinstance(config[k], kind) or (kind is not bool and isinstance(config[k], bool)) or not ok(config[k]):
            wrong.append(f"invalid: {k}")
    for node, needs in (graph or {}).items():
        wrong += [f"unknown node: {m} in {node}" for m in needs if m not in graph]
    try:
        closure(graph or {}, list(graph or {}))
    except ValueError as e:
        wrong.append(str(e))
    return wrong
