"""The one error type of the contract: a rule's name and what broke it."""


class ContractError(ValueError):
    def __init__(self, rule: str, detail: str):
        super().__init__(f"{rule}: {detail}")
        self.rule, self.detail = rule, detail
