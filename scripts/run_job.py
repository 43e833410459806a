"""Script file for spark-submit: runs a job of ``evlog.cli``."""

from evlog.cli import main

if __name__ == "__main__":
    main()
