"""The option grammar ``key=value,key=value`` of vector columns and searches."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_LENGTH = 128
MIN_DIM, MAX_DIM = 2, 4096
DEFAULT_K, MAX_K = 10, 10_000
TYPES = ("KNN", "HNSW", "HNSW_BV", "IVF")
METRICS = {"L2": "L2", "EUCLIDEAN": "L2", "IP": "IP", "COSINE": "COSINE", "COSINENORM": "COSINE", "ANGULAR": "COSINE", "HAMMING": "HAMMING"}


class OptionError(ValueError):
    """A malformed option string or a value out of range."""


def parse(text: str | None) -> dict[str, str]:
    """Options in lower-case keys; what stands up to the first ``|`` is skipped, later duplicates win."""
    text = (text or "").split("|", 1)[-1].strip()
    out: dict[str, str] = {}
    if not text:
        return out
    for item in text.split(","):
        key, eq, value = item.partition("=")
        if not eq or not key.strip() or not value.strip():
            raise OptionError(f"malformed option {item!r}")
        out[key.strip().lower()] = value.strip()
    return out


def integer(options: dict[str, str], key: str, default: int) -> int:
    """An option that is wholly an integer, else the default."""
    try:
        return int(options.get(key, default))
    except ValueError:
        return default


def metric(name: str | None) -> str:
    """The canonical name of a metric."""
    try:
        return METRICS[(name or "").upper()]
    except KeyError:
        raise OptionError(f"unknown metric {name!r}") from None


@dataclass(frozen=True)
class ColumnOptions:
    """Options of a vector column."""

    dim: int
    type: str = "KNN"
    dist: str = "L2"
    size: int = 0
    m: int = 16
    ef: int = 100
    ef_search: int = 100
    nlist: int = 64
    online: bool = False
    idcol: str | None = None
    track: str | None = None
    raw: dict = field(default_factory=dict, hash=False, compare=False)

    @classmethod
    def of(cls, text: str) -> ColumnOptions:
        if len(text.split("|", 1)[-1]) > MAX_LENGTH:
            raise OptionError("the option string is too long")
        o = parse(text)
        if not o.get("dim", "").isdigit():
            raise OptionError("dim is required")
        dim, kind = int(o["dim"]), o.get("type", "KNN").upper()
        if not MIN_DIM <= dim <= MAX_DIM:
            raise OptionError(f"dim must be {MIN_DIM} to {MAX_DIM}")
        if kind not in TYPES:
            raise OptionError(f"unknown index type {kind!r}")
        dist = metric(o.get("dist", "HAMMING" if kind == "HNSW_BV" else "L2"))
        m = min(10_000, max(2, integer(o, "m", 16)))
        ef = max(m, integer(o, "ef", 100))
        return cls(dim, kind, dist, integer(o, "size", 0), m, ef, integer(o, "ef_search", ef), max(1, integer(o, "nlist", 64)), o.get("online", "").upper() == "Y", o.get("idcol"), o.get("track"), o)

    def text(self) -> str:
        own = {"type": self.type, "dim": str(self.dim)}
        return ",".join(f"{k}={v}" for k, v in (own | {k: v for k, v in self.raw.items() if k not in own}).items())


def search_options(value: str | int | None, default_ef: int = 100) -> tuple[int, int]:
    """Neighbours and search effort, from an integer (neighbours) or an option string."""
    if value is None or str(value).strip() == "":
        return DEFAULT_K, default_ef
    text = str(value).strip()
    o = {"nn": text} if text.lstrip("-").isdigit() else parse(text)
    k = integer(o, "nn", DEFAULT_K)
    return (DEFAULT_K if k <= 0 else min(k, MAX_K)), max(1, integer(o, "ef_search", default_ef))
