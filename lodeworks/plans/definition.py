"""Index definitions: declared field types, capabilities, validation, fingerprints and a builder. All driver-side."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace
from enum import StrEnum

KINDS = ("path", "metadata", "typed", "text", "vector", "hybrid", "tree_manifest", "tensor_manifest")
METADATA = tuple("path version content_type content_length content_hash committed_at_unix_millis".split())
METRICS = ("dot", "cosine", "euclidean")
NAME_BYTES = 128


class Invalid(ValueError):
    """A definition or query that is refused before any job runs."""


class Type(StrEnum):
    BOOLEAN, SIGNED, UNSIGNED, FLOAT, KEYWORD, TEXT = "boolean", "signed", "unsigned", "float", "keyword", "text"


class Cap(StrEnum):
    EXACT, PREFIX, RANGE, ORDER, FACET, AGGREGATE, FULL_TEXT = "exact", "prefix", "range", "order", "facet", "aggregate", "full_text"


_NUMBER = {Cap.EXACT, Cap.RANGE, Cap.ORDER, Cap.FACET, Cap.AGGREGATE}
ALLOWED = {
    Type.BOOLEAN: {Cap.EXACT, Cap.FACET},
    Type.SIGNED: _NUMBER,
    Type.UNSIGNED: _NUMBER,
    Type.FLOAT: _NUMBER,
    Type.KEYWORD: {Cap.EXACT, Cap.PREFIX, Cap.RANGE, Cap.ORDER, Cap.FACET},
    Type.TEXT: {Cap.FULL_TEXT},
}
SPARK = {Type.BOOLEAN: "boolean", Type.SIGNED: "bigint", Type.UNSIGNED: "decimal(20,0)", Type.FLOAT: "double", Type.KEYWORD: "string", Type.TEXT: "string"}


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    capabilities: frozenset[Cap]
    pointer: str = ""
    multi: bool = False

    def needs(self, cap: Cap) -> None:
        if cap not in self.capabilities:
            raise Invalid(f"field {self.name} has no capability {cap}")


@dataclass(frozen=True)
class Definition:
    name: str
    kind: str = "typed"
    tenant: str = "t"
    bucket: str = "b"
    path_prefix: str = ""
    content_type: str | None = None
    fields: tuple[Field, ...] = ()
    physical_order: tuple[tuple[str, bool], ...] = ()  # (field, descending)
    dimensions: int = 0
    metric: str = "dot"
    normalize: bool = False
    text_weight: float = 0.0
    vector_weight: float = 0.0
    selector: tuple[str, ...] = ()
    command_id: str = ""
    version: int = 1

    @property
    def index_id(self) -> str:
        """Stable for (tenant, bucket, name, command)."""
        return hashlib.sha256("\0".join((self.tenant, self.bucket, self.name, self.command_id)).encode()).hexdigest()[:32]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise Invalid(f"no field {name}")

    def weights(self) -> tuple[float, float]:
        return (1.0, 1.0) if self.text_weight == self.vector_weight == 0 else (self.text_weight, self.vector_weight)

    def fingerprint(self) -> str:
        """Another value for any change that can change results."""
        body = {k: v for k, v in asdict(self).items() if k not in ("version", "command_id", "name", "tenant", "bucket")}
        return hashlib.sha256(json.dumps(body, sort_keys=True, default=lambda x: sorted(x)).encode()).hexdigest()

    def stored(self) -> dict:
        """JSON values, from which restored() makes an equal definition."""
        return json.loads(json.dumps(asdict(self), default=sorted))

    @staticmethod
    def restored(body: dict) -> Definition:
        fields = tuple(Field(f["name"], Type(f["type"]), frozenset(map(Cap, f["capabilities"])), f["pointer"], f["multi"]) for f in body["fields"])
        order = tuple((n, bool(down)) for n, down in body["physical_order"])
        return Definition(**(body | {"fields": fields, "physical_order": order, "selector": tuple(body["selector"])}))

    def validate(self) -> Definition:
        if self.kind not in KINDS:
            raise Invalid(f"kind {self.kind}")
        if not self.name or len(self.name.encode()) > NAME_BYTES:
            raise Invalid("a name has 1 to 128 bytes")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise Invalid("field names must be unique")
        if self.kind == "metadata" and not set(names) <= set(METADATA):
            raise Invalid("unknown metadata field")
        for f in self.fields:
            if not f.capabilities or not f.capabilities <= ALLOWED[f.type]:
                raise Invalid(f"capabilities of {f.name} don't fit {f.type}")
            if f.multi and Cap.ORDER in f.capabilities:
                raise Invalid(f"{f.name} has several values and can't be ordered by")
            if f.pointer and not re.fullmatch(r"(/([^~]|~[01])*)+", f.pointer):
                raise Invalid(f"pointer {f.pointer}")
        ordered = [n for n, _ in self.physical_order]
        if len(set(ordered)) != len(ordered):
            raise Invalid("physical order repeats a field")
        for n in ordered:
            self.field(n).needs(Cap.ORDER)
        if self.kind in ("vector", "hybrid") and (self.dimensions <= 0 or self.metric not in METRICS):
            raise Invalid("a vector index has dimensions and a metric")
        if self.kind == "hybrid" and (self.text_weight == 0) != (self.vector_weight == 0):
            raise Invalid("one weight is zero")
        if min(self.text_weight, self.vector_weight) < 0:
            raise Invalid("weights are 0 or more")
        if self.kind in ("text", "hybrid") and not any(f.type is Type.TEXT for f in self.fields):
            raise Invalid("no text field")
        return self


@dataclass
class Builder:
    """Typed construction of a definition; build() validates."""

    definition: Definition
    fields: list[Field] = field(default_factory=list)

    def add(self, name: str, type_: Type, *caps: Cap, pointer: str = "", multi: bool = False) -> Builder:
        self.fields.append(Field(name, type_, frozenset(caps), pointer or f"/{name}", multi))
        return self

    def keyword(self, name: str, *caps: Cap, **kw) -> Builder:
        return self.add(name, Type.KEYWORD, *caps, **kw)

    def signed(self, name: str, *caps: Cap, **kw) -> Builder:
        return self.add(name, Type.SIGNED, *caps, **kw)

    def unsigned(self, name: str, *caps: Cap, **kw) -> Builder:
        return self.add(name, Type.UNSIGNED, *caps, **kw)

    def floating(self, name: str, *caps: Cap, **kw) -> Builder:
        return self.add(name, Type.FLOAT, *caps, **kw)

    def boolean(self, name: str, *caps: Cap, **kw) -> Builder:
        return self.add(name, Type.BOOLEAN, *caps, **kw)

    def text(self, name: str, **kw) -> Builder:
        return self.add(name, Type.TEXT, Cap.FULL_TEXT, **kw)

    def build(self) -> Definition:
        return replace(self.definition, fields=tuple(self.fields)).validate()


class Store:
    """The definitions of a catalog: create, compare-and-set update, list, rebuild, delete. Each call reads the stored document and each change writes its next
    version, so that another process sees it and one of two writers at once is refused. Without a document the state lasts as long as the store."""

    REBUILD_SECONDS = 3600

    def __init__(self, document=None) -> None:
        self.document, self.number = document, 0
        self.rows: dict[tuple[str, str, str], Definition] = {}
        self.rebuilt: dict[str, float] = {}

    def _load(self) -> None:
        if self.document is not None:
            self.number, value = self.document.read()
            each = [Definition.restored(d) for d in (value or {"definitions": []})["definitions"]]
            self.rows, self.rebuilt = {(d.tenant, d.bucket, d.name): d for d in each}, dict((value or {"rebuilt": {}})["rebuilt"])

    def _save(self) -> None:
        if self.document is not None:
            self.number = self.document.write({"definitions": [d.stored() for _, d in sorted(self.rows.items())], "rebuilt": self.rebuilt}, self.number)

    def create(self, d: Definition) -> Definition:
        self._load()
        key = (d.tenant, d.bucket, d.name)
        old = self.rows.get(key)
        if old is not None:
            if old.command_id == d.command_id and old.fingerprint() == d.fingerprint():
                return old
            raise Invalid("it exists")
        self.rows[key] = d.validate()
        self._save()
        return d

    def get(self, tenant: str, bucket: str, name: str) -> Definition:
        self._load()
        if (tenant, bucket, name) not in self.rows:
            raise Invalid("no such index")
        return self.rows[tenant, bucket, name]

    def update(self, d: Definition, expected_version: int) -> Definition:
        old = self.get(d.tenant, d.bucket, d.name)
        if old.version != expected_version:
            raise Invalid(f"version is {old.version}")
        new = replace(d, version=old.version + 1, command_id=old.command_id).validate()
        self.rows[d.tenant, d.bucket, d.name] = new
        self._save()
        return new

    def delete(self, tenant: str, bucket: str, name: str, expected_version: int) -> Definition:
        old = self.get(tenant, bucket, name)
        if old.version != expected_version:
            raise Invalid(f"version is {old.version}")
        self.rows.pop((tenant, bucket, name))
        self._save()
        return old

    def list(self, tenant: str, bucket: str, after: str = "", limit: int = 100, allowed=lambda d: True) -> tuple[list[Definition], bool]:
        if not 1 <= limit <= 1000:
            raise Invalid("limit is 1 to 1000")
        self._load()
        found = [d for k, d in sorted(self.rows.items()) if k[:2] == (tenant, bucket) and k[2].encode() > after.encode() and allowed(d)]
        return found[:limit], len(found) > limit

    def rebuild(self, d: Definition, now: float) -> Definition:
        """Admits a rebuild, once an hour for a definition."""
        self._load()
        if now - self.rebuilt.get(d.index_id, -1e18) < self.REBUILD_SECONDS:
            raise Invalid("rebuilt less than an hour ago")
        self.rebuilt[d.index_id] = now
        self._save()
        return d
