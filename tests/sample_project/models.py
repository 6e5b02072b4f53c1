"""Records of the shop."""


class BaseEntity:
    """What every record has."""

    def __init__(self, entity_id: int):
        self.entity_id = entity_id

    def get_id(self) -> int:
        return self.entity_id


class User(BaseEntity):
    def __init__(self, entity_id: int, email: str):
        super().__init__(entity_id)
        self.email = email

    def validate_email(self):
        return "@" in self.email

    def deactivate(self):
        self.email = ""


class Order(BaseEntity):
    def mark_as_paid(self):
        self.paid = True
