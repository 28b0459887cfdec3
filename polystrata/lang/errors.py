"""What a script is told when it is refused."""


class Refused(ValueError):
    """A statement that isn't carried out; `kind` names the reason."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind
