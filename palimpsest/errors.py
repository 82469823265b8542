"""What can go wrong, as exception classes."""


class EngineError(Exception):
    """Base of all errors of this engine."""


class LogDirectoryRequired(EngineError):
    """A table needs a place for its log."""


class TableAlreadyExists(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class TwoPrimaryKeys(EngineError):
    pass


class PrimaryKeyNotDefined(EngineError):
    pass


class DuplicateKey(EngineError):
    """An insert's primary key is, or once was, in the table."""


class InvalidKeyType(EngineError):
    """A key or an indexed field is missing, null, or of another type than its index."""


class KeyMismatch(EngineError):
    """A given key differs from the document's field."""


class TransactionFinished(EngineError):
    """The transaction has been committed or rolled back."""


class SerializationConflict(EngineError):
    """A key that the transaction read has changed since; the transaction is aborted."""


class LockWaitTimeout(EngineError):
    pass


class DeadlockVictim(EngineError):
    pass


class CommitAborted(EngineError):
    """Recovery gave up the commit before it was published."""


class CorruptLog(EngineError):
    """A published commit lacks files or can't be read."""


class BackupError(EngineError):
    """A backup's manifest and files differ, or a target isn't empty."""


class DecryptionError(EngineError):
    """A wrapped key doesn't open with this master key."""


class UnsupportedStore(EngineError):
    """A root's file system can't give a commit's number to one writer alone."""


class EngineClosed(EngineError):
    """The engine has been closed."""
