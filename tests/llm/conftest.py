import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# in a run of the whole suite ``conftest`` is this file, also for the tests beside this folder that import its names
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
