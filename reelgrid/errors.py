"""Errors of this package; every one is logged when it is raised."""

from __future__ import annotations

import logging

log = logging.getLogger("reelgrid")


class ReelgridError(Exception):
    """Base of all errors."""

    def __init__(self, *args: object) -> None:
        super().__init__(*args)
        log.debug("%s: %s", type(self).__name__, self)


class DataAccessError(ReelgridError):
    """A relation, archive or destination cannot be used."""


class ParseError(ReelgridError):
    """A text cannot be understood."""
