"""Configuration and result records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from washline.errors import ValidationError
from washline.operators.outliers import METHODS


@dataclass
class CleaningConfig:
    """What a cleaning run does. The first seven fields are the everyday switches."""

    outliers: str | None = "cap"
    normalize_cols: bool = True
    clean_text: bool = True
    categorical_mapping: dict[str, dict[str, str]] | None = None
    auto_outlier_detect: bool = True
    verbose: bool = False
    profile: bool = False
    # Options beyond the defaults; each default keeps the usual behaviour.
    tokens_after_strip: bool = False
    bare_digit_dates: bool = True
    ignore_currency_code_case: bool = True
    quantile_accuracy: int | None = None

    def validate(self) -> None:
        """Raise ValidationError for an unknown outlier method or a malformed mapping."""
        if self.outliers not in METHODS:
            raise ValidationError(f"outliers is {self.outliers!r}; choose from {METHODS}")
        mapping = self.categorical_mapping
        if mapping is None:
            return
        if not isinstance(mapping, dict):
            raise ValidationError("categorical_mapping maps column names to dictionaries")
        wrong = [c for c, values in mapping.items() if not isinstance(values, dict)]
        if wrong:
            raise ValidationError(f"categorical_mapping: no dictionary for column(s) {wrong}")


@dataclass
class Findings:
    """Errors decide over success; warnings only inform."""

    errors: list[str] = field(default_factory=list, kw_only=True)
    warnings: list[str] = field(default_factory=list, kw_only=True)

    @property
    def success(self) -> bool:
        return not self.errors

    @property
    def failed(self) -> bool:
        return not self.success

    def add_error(self, message: str) -> None:
        self.errors.append(message)

    def add_warning(self, message: str) -> None:
        self.warnings.append(message)


@dataclass
class ValidationResult(Findings):
    """Outcome of a validation."""


@dataclass
class CleaningResult(Findings):
    """Outcome of a file-to-file cleaning run."""

    rows: int = 0
    columns: int = 0
    duplicates_removed: int = 0
    outliers_handled: int = 0
    missing_filled: int = 0
    columns_standardized: int = 0
    text_unconverted: int = 0
    duration: str = ""

    def to_dict(self) -> dict[str, object]:
        return asdict(self)
