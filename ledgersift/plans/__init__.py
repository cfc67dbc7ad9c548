from .methods import METHODS, MethodResult, run_method

__all__ = ["METHODS", "MethodResult", "run_method"]
