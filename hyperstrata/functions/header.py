"""Grid headers: sampling of up to nine axes, kept beside the data as plan-time metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

MAX_AXES = 9


@dataclass(frozen=True)
class Axis:
    """``n`` samples at ``o + i*d``; n is None where traces differ in length."""

    n: int | None = None
    o: float = 0.0
    d: float = 1.0
    label: str = ""
    unit: str = ""

    def index(self, x: float) -> int:
        """The nearest index of a coordinate, rounding half up and truncating like an integer cast."""
        return int(0.5 + (x - self.o) / self.d)

    def coordinate(self, i: int) -> float:
        return self.o + i * self.d


@dataclass(frozen=True)
class Header:
    axes: tuple[Axis, ...]
    kind: str = "float"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= len(self.axes) <= MAX_AXES:
            raise ValueError(f"a grid has 1 to {MAX_AXES} axes, not {len(self.axes)}")

    def axis(self, k: int) -> Axis:
        return self.axes[k - 1]

    def with_axis(self, k: int, **changes) -> Header:
        axes = list(self.axes)
        axes[k - 1] = replace(axes[k - 1], **changes)
        return replace(self, axes=tuple(axes))

    def put(self, **keys) -> Header:
        """Set header keys: n1=, o2=, label1=, ... change axes; any other key rides along."""
        out, extra = self, dict(self.extra)
        for key, value in keys.items():
            name, digit = key[:-1], key[-1:]
            if digit.isdigit() and name in ("n", "o", "d", "label", "unit"):
                while len(out.axes) < int(digit):
                    out = replace(out, axes=(*out.axes, Axis(n=1)))
                out = out.with_axis(int(digit), **{name: value})
            else:
                extra[key] = value
        return replace(out, extra=extra)

    def get(self, key: str):
        name, digit = key[:-1], key[-1:]
        if digit.isdigit() and name in ("n", "o", "d", "label", "unit") and int(digit) <= len(self.axes):
            return getattr(self.axis(int(digit)), name)
        return self.extra[key]

    def check_like(self, other: Header, but: int | None = None, slack: float = 1e-3) -> None:
        """Raise if sizes differ off axis ``but``, or origins and steps by more than ``slack`` steps."""
        if len(self.axes) != len(other.axes):
            raise ValueError("numbers of axes differ")
        for k, (a, b) in enumerate(zip(self.axes, other.axes, strict=True), 1):
            if k == but:
                continue
            if a.n is not None and b.n is not None and a.n != b.n:
                raise ValueError(f"n{k} differs: {a.n} and {b.n}")
            if abs(a.d - b.d) > slack * abs(a.d) or abs(a.o - b.o) > slack * abs(a.d):
                raise ValueError(f"o{k} or d{k} differs")


def parse_parameters(text: str) -> dict[str, str]:
    """``key=value`` words, the last one winning; quotes keep spaces together."""
    import shlex

    found = {}
    for word in shlex.split(text, comments=False):
        key, eq, value = word.partition("=")
        if eq and key:
            found[key] = value
    return found


def parse_list(value: str, kind=float) -> list:
    """A comma list with repeats: ``1,2x4.0,2.25`` is 1, 4, 4, 2.25."""
    out = []
    for item in value.split(","):
        times, x, rest = item.partition("x")
        many, what = (int(times), rest) if x and times.isdigit() and rest else (1, item)
        if kind is bool:
            out += [what[:1].lower() in ("y", "t", "1")] * many
        else:
            out += [kind(what)] * many
    return out
