"""Errors that pipelines raise."""


class PipelineError(Exception):
    """Base of all."""


class ForeignIo(PipelineError):
    """A peer, a device or a file outside can't be reached, read or written."""


class ForeignSourceTimeout(PipelineError):
    """A source outside gave nothing in time."""


class CoreIo(PipelineError):
    """The folders that a pipeline keeps its rows in can't be used."""


class ThreadPoisoned(PipelineError):
    """A thread of the pipeline has ended with an error; later calls raise this with it as the cause."""


class SqlError(PipelineError):
    """A statement that can't be parsed or analysed, or a value that doesn't fit its column."""


class InvalidOption(PipelineError):
    """An option of a reader or writer is missing or wrong."""


class InvalidConfig(PipelineError):
    """A configuration file has unknown or wrong values."""


class InvalidFormat(PipelineError):
    """Input that isn't a flat JSON object."""


class InputTimeout(PipelineError):
    """No row came in time."""


class Unavailable(PipelineError):
    """A queue or stream that doesn't exist."""


class NullValue(PipelineError):
    """NULL where a value was asked for."""


class TimeError(PipelineError):
    """A text that isn't a time, or a time that can't be represented."""
