from ..models import Order, User
from ..utils.calculator import calculate_discount
from .payment_service import process_checkout_payment


def checkout_order(
    email: str,
    price: float,
) -> dict:
    user = User(1, email)
    if not user.validate_email():  # a comment with call()
        return {}
    final = calculate_discount(price)
    order = Order(2)
    process_checkout_payment(final)
    order.mark_as_paid()
    return {"id": order.get_id()}
