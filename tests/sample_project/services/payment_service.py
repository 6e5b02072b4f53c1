from ..utils.calculator import calculate_tax


class PaymentProcessor:
    def execute_payment(self, amount: float):
        total = amount + calculate_tax(amount)
        return total


def process_checkout_payment(amount: float):
    processor = PaymentProcessor()
    return processor.execute_payment(amount)
