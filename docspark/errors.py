"""Errors of the engine, raised when a query is planned."""


class EngineError(Exception):
    pass


class InvalidArgument(EngineError, ValueError):
    pass


class SpaceNotFound(EngineError):
    pass


class SpaceExists(EngineError):
    pass


class CollectionNotFound(EngineError):
    pass


class CollectionExists(EngineError):
    pass


class DuplicateKey(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class IndexExists(EngineError):
    pass


class TransactionError(EngineError):
    pass


class CursorClosed(EngineError):
    pass
