import os
import sys

sys.path[:0] = [os.path.dirname(__file__), os.path.join(os.path.dirname(__file__), "..", "..", "tools")]
