"""Table cleaning on Spark DataFrames."""

from washline.errors import (
    CleanIOError,
    DataCleaningError,
    DataLoadError,
    DependencyError,
    InvalidInputError,
    ValidationError,
    WashlineError,
)
from washline.plans.cleaning import clean_data, fit, run_cleaning
from washline.plans.config import CleaningConfig, CleaningResult, ValidationResult
from washline.plans.jobs import clean_file
from washline.plans.model import CleaningModel
from washline.sources.files import read_data, write_data

__version__ = "0.1.0"

__all__ = [
    "CleanIOError",
    "CleaningConfig",
    "CleaningModel",
    "CleaningResult",
    "DataCleaningError",
    "DataLoadError",
    "DependencyError",
    "InvalidInputError",
    "ValidationError",
    "ValidationResult",
    "WashlineError",
    "clean_data",
    "clean_file",
    "fit",
    "read_data",
    "run_cleaning",
    "write_data",
    "__version__",
]
