import sys

from tidepool.plans.session import main

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
