import os
import sys

sys.path.insert(0, os.path.dirname(__file__))  # the pipeline's tests share the operators' plain versions
