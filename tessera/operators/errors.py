"""Rejections carry a code; operators turn them into an error_code column and never fail the job."""


class Rejected(Exception):
    """Input that the format forbids."""

    def __init__(self, code: str, detail: int | None = None):
        super().__init__(code if detail is None else f"{code}({detail})")
        self.code, self.detail = code, detail
