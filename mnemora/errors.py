"""Errors of the engine."""


class MnemoraError(Exception):
    """Any error of this library."""


class StorageError(MnemoraError):
    pass


class ReadOnlyError(StorageError):
    pass


class ConfigError(MnemoraError):
    pass


class EmbeddingError(MnemoraError):
    pass


class ValidationError(MnemoraError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class NotFoundError(MnemoraError):
    def __init__(self, kind: str, key: object):
        super().__init__(f"{kind} {key} not found")
        self.kind, self.key = kind, key


class SyncError(MnemoraError):
    pass
