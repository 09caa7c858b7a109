"""What can be wrong before any job runs."""


class BinningMismatch(ValueError):
    """Two histograms do not have the same axes."""


class DuplicateName(ValueError):
    """A store already holds an object of this name."""


class SchemaChanged(ValueError):
    """A batch does not have the columns of the first one."""
