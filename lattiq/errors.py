"""One exception for each family of guards."""


class PanelError(ValueError):
    """A table breaks the contract of its operator: columns, keys, dates, signs."""


class LeakageError(ValueError):
    """Values from after the permitted window reached an analysis."""


class EvaluationError(ValueError):
    """An evaluation would cross its frozen boundary."""


class SelectionError(ValueError):
    """Candidate selection would see what it must not."""


class DiagnosticError(SelectionError):
    """Diagnostics of a selection were given forecasts from after it."""


class HoldoutError(ValueError):
    """The one-time holdout would be opened again, or otherwise than locked."""


class FeatureError(ValueError):
    """Features break their temporal contract."""


class ContractError(ValueError):
    """A raw file, a quality check or a lineage record is not what was declared."""
