"""Run settings: values as the command line gives them, frozen records, names of artifacts."""

from __future__ import annotations

import argparse
import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from pathlib import PurePosixPath

TRUE, FALSE = {"1", "true", "t", "yes", "y"}, {"0", "false", "f", "no", "n"}


def parse_bool(s: str | bool) -> bool:
    if isinstance(s, bool):
        return s
    if (low := s.strip().lower()) in TRUE | FALSE:
        return low in TRUE
    raise argparse.ArgumentTypeError(f"neither true nor false: {s!r}")


def parse_ints(s: str) -> tuple[int, ...]:
    try:
        return tuple(int(p) for p in s.split(",") if p.strip())
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a list of integers: {s!r}") from None


def parse_rank(s: str, order: int | None = None) -> tuple[int, ...]:
    """One rank a mode; a single one stands for all."""
    found = parse_ints(s)
    return found * order if order and len(found) == 1 else found


def parse_columns(s: str) -> tuple[str, ...]:
    found = tuple(p.strip() for p in s.split(",") if p.strip())
    if s and not found:
        raise argparse.ArgumentTypeError("no column is named")
    return found


def parse_links(s: str | None, order: int | None = None) -> tuple[tuple[int, int], ...] | str | None:
    """Linked modes, as in 1-2,2:0; "all" (every pair, once the order is known); none."""
    low = (s or "").strip().lower()
    if low in ("", "none", "null", "no"):
        return None
    if low == "all":
        return "all" if order is None else tuple((a, b) for a in range(order) for b in range(a + 1, order))
    pairs = set()
    for part in filter(None, (p.strip() for p in low.split(","))):
        m = re.fullmatch(r"(\d+)\s*[-:]\s*(\d+)", part)
        if not m or m[1] == m[2]:
            raise argparse.ArgumentTypeError(f"not a pair of different modes: {part!r}")
        pairs.add(tuple(sorted((int(m[1]), int(m[2])))))
    return tuple(sorted(pairs)) or None


def ngram_orders(kind: str) -> tuple[int, ...]:
    """The orders in 3-gram, 4gram or a list of such; others are an error."""
    out = []
    for part in filter(None, (p.strip() for p in kind.lower().split(","))):
        m = re.fullmatch(r"(\d+)-?grams?", part)
        if not m or int(m[1]) < 1:
            raise ValueError(f"not an n-gram type: {part!r}")
        out.append(int(m[1]))
    return tuple(dict.fromkeys(out))


#: Short names of corpora; a deployment adds its own.
ALIASES: dict[str, str] = {}


def resolve_dataset(name: str, aliases: dict[str, str] | None = None) -> tuple[str, str | None]:
    """(path, configuration) of an alias, of path:configuration, or of a plain path."""
    name = (aliases or ALIASES).get(name, name)
    if "://" in name or ":" not in name:
        return name, None
    path, _, configuration = name.rpartition(":")
    return path, configuration


def label(path: str) -> str:
    return path.strip("/").replace("/", "-")


@dataclass(frozen=True)
class Record:
    """Settings with an id that depends on their meaning, not on where data lie."""

    def run_id(self) -> str:
        known = {k: v for k, v in asdict(self).items() if not k.endswith(("_dir", "_path"))}
        return hashlib.sha1(json.dumps(known, sort_keys=True).encode()).hexdigest()[:10]


@dataclass(frozen=True)
class Ingest(Record):
    type: str = "3-gram"
    dataset: str = ""
    text_column: str = "text"
    language: str = "en"
    target_rows: int = 10_000_000
    rows_per_file: int = 5_000_000
    longest_text: int = 50_000
    output_dir: str = "vectors"

    def folder(self, n: int | None = None) -> str:
        """One layout for writers and readers: output/<corpus>/<type>."""
        return str(PurePosixPath(self.output_dir, label(self.dataset or "corpus"), f"{n}-gram" if n else label(self.type)))


@dataclass(frozen=True)
class Population(Record):
    dataset: str = ""
    top_ks: tuple[int, ...] = (1000, 2000, 4000, 6000)
    roles: tuple[str, ...] = ("root", "nsubj", "obj")
    shared: tuple[tuple[int, int], ...] = ()
    data_dir: str = "data"


@dataclass(frozen=True)
class Decomposition(Record):
    method: str = "siiSoftPlus"
    divergence: str = "kl"
    dim: int = 1000
    rank: tuple[int, ...] = (100, 100, 100)
    shared: tuple[tuple[int, int], ...] = ()
    iterations: int = 100
    share: float = 1.0
    seed: int = 42
    data_dir: str = "data"
    transitive: bool = True
    share_warmup: int = 0
    normalise: bool = False
    tol: float = 1e-5
    patience: int = 5
    warmup: int = 0
    log_every: int = 1
    check_every: int = 1
    semantic_every: int = 0
    semantic_key: str = "average_rank_score"
    temperature: float = 0.1
    evaluation_path: str = ""
    evaluation_rows: int = 10_000
    known_only: bool = False
    checkpoint_every: int = 0
    save_best: bool = True
    resume: bool = False
    overwrite: bool = False
    log_path: str = ""

    def stem(self) -> str:
        """What all files of a model are named after."""
        from .operators.vocab import groups, shared_suffix

        links = shared_suffix(groups(len(self.rank), list(self.shared)))
        part = f"_p{self.share:g}" if self.share < 1 else ""
        return f"{self.method}_{len(self.rank)}D_{self.dim}d_{self.divergence}_r{'-'.join(map(str, self.rank))}_s{self.seed}{links}{part}"

    def paths(self) -> dict[str, str]:
        base = PurePosixPath(self.data_dir, "models", self.stem())
        return {k: str(base / k) for k in ("model", "best", "errors", "fitness", "config.json", "checkpoints", "runs.jsonl")}

    def structure(self) -> dict:
        """What a checkpoint must share to be continued."""
        return {k: getattr(self, k) for k in ("method", "divergence", "dim", "rank", "shared", "share", "seed", "transitive", "share_warmup", "normalise")}


def parser(kind: type[Record]) -> argparse.ArgumentParser:
    """Flags for every field of a record: --top-ks 100,200 --shared 1-2."""
    out = argparse.ArgumentParser()
    for f in fields(kind):
        convert = {"top_ks": parse_ints, "rank": parse_rank, "roles": parse_columns, "shared": lambda s: parse_links(s) or ()}.get(f.name)
        if convert is None:
            convert = {bool: parse_bool}.get(type(f.default), type(f.default))
        out.add_argument(f"--{f.name.replace('_', '-')}", type=convert, default=f.default)
    return out


def parsed(kind: type[Record], argv: Sequence[str]) -> Record:
    """A record from flags; one rank is repeated, and "all" links are spelled out, once the order is known."""
    values = vars(parser(kind).parse_args(list(argv)))
    order = len(values.get("roles") or values.get("rank") or ())
    if values.get("shared") == "all":
        values["shared"] = parse_links("all", order)
    if (rank := values.get("rank")) and len(rank) == 1:
        values["rank"] = rank * 3
    return kind(**values)
