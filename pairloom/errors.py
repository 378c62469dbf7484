"""Errors of the engine; a command line turns them into exit status 1."""


class ApplicationException(Exception):
    """Base of the errors that a user can mend."""


class UnknownEnzymeException(ApplicationException):
    def __init__(self, name: str, similar: list[str]):
        hint = f"; similar names: {', '.join(similar)}" if similar else ""
        super().__init__(f"{name} is no known enzyme{hint}")
        self.similar = similar


class UnknownOrientationStateException(ApplicationException):
    def __init__(self, ori: object):
        super().__init__(f"{ori} is no orientation: 1 or -1 is")


class NoneAcceptedException(ApplicationException):
    def __init__(self) -> None:
        super().__init__("no sequence is accepted by the length and signal limits")


class TooFewException(ApplicationException):
    pass


class NoRemainingClustersException(ApplicationException):
    pass


class NoReportException(ApplicationException):
    def __init__(self, cluster: object):
        super().__init__(f"cluster {cluster} has no report")


class ZeroLengthException(ApplicationException):
    def __init__(self, name: str):
        super().__init__(f"sequence {name} has no length")


class ParsingError(ApplicationException):
    pass
