"""Settings from INI or TOML files, partial files over defaults, with validation."""

from __future__ import annotations

import configparser
import tomllib
from dataclasses import asdict, dataclass, field, fields


@dataclass
class IndexConfig:
    d: int = 128
    nlist: int = 256
    nbits: int = 4
    niter: int = 20
    use_sq8: bool = True
    is_inner_product: bool = False
    hadamard_seed: int = 12345
    kmeans_seed: int = 42

    def validate(self) -> None:
        if not 1 <= self.nbits <= 8:
            raise ValueError("nbits must be between 1 and 8")
        for name in ("d", "nlist", "niter"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


@dataclass
class StorageConfig:
    path: str = "./index"
    compression: str = "zstd"
    row_group_mb: int = 64

    def validate(self) -> None:
        if not self.path:
            raise ValueError("path must not be empty")


@dataclass
class QueryConfig:
    k: int = 10
    nprobe: int = 8
    refine_factor: int = 10

    def validate(self) -> None:
        if min(self.k, self.nprobe, self.refine_factor) <= 0:
            raise ValueError("k, nprobe and refine_factor must be positive")


_TRUE = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}


@dataclass
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    query: QueryConfig = field(default_factory=QueryConfig)

    @classmethod
    def parse(cls, text: str, kind: str) -> Config:
        if kind == "toml":
            raw = tomllib.loads(text)
        else:
            p = configparser.ConfigParser()
            p.read_string(text)
            raw = {s: dict(p[s]) for s in p.sections()}
        out = cls()
        for f in fields(cls):
            part = getattr(out, f.name)
            for g in fields(part):
                if g.name in raw.get(f.name, {}):
                    v, now = raw[f.name][g.name], getattr(part, g.name)
                    if isinstance(now, bool) and isinstance(v, str):
                        if v.strip().lower() not in _TRUE:
                            raise ValueError(f"{f.name}.{g.name}: {v!r} is not a truth value")
                        v = _TRUE[v.strip().lower()]
                    setattr(part, g.name, type(now)(v))
        out.validate()
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read(), "toml" if path.endswith(".toml") else "ini")

    def validate(self) -> None:
        for f in fields(self):
            getattr(self, f.name).validate()

    def dump(self, kind: str) -> str:
        show = (lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)) if kind == "toml" else (lambda v: str(v).lower() if isinstance(v, bool) else str(v))
        return "\n".join(f"[{s}]\n" + "".join(f"{k} = {show(v)}\n" for k, v in part.items()) for s, part in asdict(self).items())
