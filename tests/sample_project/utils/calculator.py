def calculate_discount(price: float, rate: float = 0.1) -> float:
    """Lower a price.

    Args:
        price (float): the price before
        rate: the share taken off

    Returns:
        the price after
    """
    return price * (1 - rate)


def calculate_tax(amount: float) -> float:
    return amount * 0.2


def unused_legacy_formula(x):
    return x + 1
