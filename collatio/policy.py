"""Evaluation policies: how texts are read before they are compared."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

UNICODE = ("NFC", "NFKC", "NFD", "NFKD", "none")
CASE = ("preserve", "lower", "upper")
WHITESPACE = ("preserve", "collapse", "trim")
PUNCTUATION = ("preserve", "remove")
CHAR_UNITS = ("grapheme", "codepoint")
UNITS = (*CHAR_UNITS, "word")
METRICS = ("cer", "wer")


def choice(name: str, value: str, allowed: tuple[str, ...]) -> str:
    """value, if it is one of the allowed ones."""
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


@dataclass(frozen=True)
class EvalPolicy:
    """What is made equal before texts are compared, in this order: unicode form, case, punctuation, whitespace."""

    unicode: str = "NFC"
    case: str = "preserve"
    whitespace: str = "preserve"
    punctuation: str = "preserve"
    char_unit: str = "grapheme"

    def __post_init__(self) -> None:
        for name, allowed in (("unicode", UNICODE), ("case", CASE), ("whitespace", WHITESPACE), ("punctuation", PUNCTUATION), ("char_unit", CHAR_UNITS)):
            choice(name, getattr(self, name), allowed)

    def for_metric(self, metric: str) -> EvalPolicy:
        """Words never keep their whitespace: wer reads preserve as collapse."""
        return replace(self, whitespace="collapse") if metric == "wer" and self.whitespace == "preserve" else self

    def unit(self, metric: str) -> str:
        return "word" if choice("metric", metric, METRICS) == "wer" else self.char_unit

    @classmethod
    def of(cls, settings: dict | EvalPolicy) -> EvalPolicy:
        """The defaults overlaid with settings; unknown settings raise."""
        if isinstance(settings, EvalPolicy):
            return settings
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown policy settings: {', '.join(sorted(unknown))}")
        return cls(**settings)

    def columns(self) -> dict[str, str]:
        """policy_* columns that keep the policy with the rows."""
        return {f"policy_{k}": v for k, v in asdict(self).items()}


def check_metrics(metrics) -> list[str]:
    """The metrics in order, each once."""
    out = list(dict.fromkeys([metrics] if isinstance(metrics, str) else metrics))
    if not out:
        raise ValueError("metrics must not be empty")
    return [choice("metric", m, METRICS) for m in out]


def check_columns(columns: list[str], *wanted: str | None) -> None:
    missing = [c for c in dict.fromkeys(wanted) if c is not None and c not in columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
