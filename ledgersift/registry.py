"""Methods that can be run, those that are only registered, and how to add one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .codes import Code, Refusal


@dataclass(frozen=True)
class MethodSpec:
    name: str
    version: str
    status: str  # implemented, registered, extension
    limits: str
    needs: tuple[str, ...] = ()
    run: Callable | None = field(default=None, compare=False)


#: Names that are known, but have no implementation.
REGISTERED = (
    "gap-sequence round-number outlier split-transaction threshold-proximity vendor-analysis employee-vendor-match duplicate-payment journal-entry date-time-anomaly velocity-analysis".split()
)

_specs: dict[str, MethodSpec] = {
    n: MethodSpec(n, "0", "registered", "Registered, not implemented; a run is refused.") for n in REGISTERED
}
_specs["custom-test"] = MethodSpec("custom-test", "0", "extension", "Extension point: register a function before running it.")


def register(spec: MethodSpec) -> None:
    known = _specs.get(spec.name)
    if known is not None and known.status == "implemented" and known.version == spec.version:
        raise Refusal(Code.BAD_CONFIGURATION, f"{spec.name}@{spec.version} is registered already")
    _specs[spec.name] = spec


def register_custom(name: str, function: Callable, roles: tuple[str, ...], limits: str, version: str = "1.0.0") -> MethodSpec:
    """An investigator's test: ``function(df, **columns)`` returns the flagged rows of df."""
    spec = MethodSpec(f"custom:{name}", version, "implemented", limits, roles, function)
    register(spec)
    return spec


def lookup(name: str) -> MethodSpec:
    spec = _specs.get(name)
    if spec is None or spec.status != "implemented":
        raise Refusal(Code.NOT_IMPLEMENTED, f"method {name!r} is {'unknown' if spec is None else spec.status}")
    return spec


def describe(pointer: str) -> dict:
    """A method's limitations, by ``name`` or ``name@version``; reads no data."""
    name, _, version = pointer.partition("@")
    spec = _specs.get(name)
    if spec is None or version and version != spec.version:
        raise Refusal(Code.NOT_IMPLEMENTED, f"no method {pointer!r}")
    return {"method": spec.name, "version": spec.version, "status": spec.status, "needs": list(spec.needs), "limits": spec.limits}


def methods() -> dict[str, str]:
    return {n: s.status for n, s in sorted(_specs.items())}
