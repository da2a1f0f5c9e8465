"""Errors of requests, assets and portfolios."""


class BourseError(ValueError):
    """Any refused request."""


class RequestError(BourseError):
    """A request's parameters don't make a query."""


class ResponseError(BourseError):
    """A vendor's envelope reports a failure."""


class NoDataError(ResponseError):
    """A vendor's envelope has no rows."""


class DelayedDataError(NoDataError):
    """A vendor's envelope is delayed and has no rows yet."""


class AssetError(BourseError):
    """An asset or its symbol is unknown."""


class PortfolioError(BourseError):
    """A portfolio doesn't allow the operation."""


class AssetNotFoundError(PortfolioError):
    """The portfolio doesn't hold the asset."""


class InvalidAssetTypeError(PortfolioError):
    """The asset's type isn't one that portfolios hold."""


class DuplicateAssetError(PortfolioError):
    """The portfolio holds the asset already."""


class EmptyPortfolioError(PortfolioError):
    """The portfolio holds nothing."""


class UnsupportedOperationError(PortfolioError):
    """Portfolios don't offer the operation."""


class UnknownSymbolError(AssetError):
    """A symbol can't be read."""


class UnknownTableError(RequestError):
    """No such table is served."""


class ConflictError(BourseError):
    """Another writer has changed the table in the meantime."""


class RowRangeError(AssetError):
    """A series has no row at the index."""
