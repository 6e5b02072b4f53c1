from sample_project.services.order_service import checkout_order


def start_application():
    return checkout_order("a@b", 10.0)


def abandoned_backup_cron():
    return None


if __name__ == "__main__":
    start_application()
