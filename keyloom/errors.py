"""Errors of arguments. Errors that depend on data become an ``error`` column of folds."""


class KeyspaceError(ValueError):
    pass


class WrongType(KeyspaceError):
    pass


class SyntaxProblem(KeyspaceError):
    pass


class OutOfRange(KeyspaceError):
    pass


class NoScript(KeyspaceError):
    pass


class BusyGroup(KeyspaceError):
    pass
