"""What can go wrong, as exceptions; a handler of a parent also gets its children."""


class EngineError(Exception):
    pass


class NotFoundError(EngineError):
    pass


class ConflictError(EngineError):
    """A write met a newer one; try again."""


class EpochMismatchError(EngineError):
    pass


class RetryExhaustedError(EngineError):
    pass


class TxNotFoundError(NotFoundError):
    pass


class SavepointNotFoundError(NotFoundError):
    pass


class TxTerminatedError(EngineError):
    pass


class TxRolledBackError(TxTerminatedError):
    pass


class TxAlreadyCommittedError(TxTerminatedError):
    pass


class TxCommitInProgressError(EngineError):
    pass


class TxTenantMismatchError(EngineError):
    pass


class GroupCardinalityExceededError(EngineError):
    pass


class SearchResultLimitExceededError(EngineError):
    pass


class ScanBudgetExhaustedError(EngineError):
    pass


class AggregationNotPushdownableError(EngineError):
    pass


class UniqueViolationError(EngineError):
    pass


class PartialUniqueKeyError(EngineError):
    pass


class UnknownOperatorError(EngineError, ValueError):
    pass
