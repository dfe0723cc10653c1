"""Objects for Python workers that have no copy of this package.

A broadcast pickles the classes of an object by reference, so a worker would have to
import them. Here the object travels as bytes that hold its classes as well.
"""

import pickle

from pyspark import Broadcast, SparkContext, cloudpickle


def sent(sc: SparkContext, value) -> Broadcast:
    return sc.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    """In a task, once: the object that was sent."""
    return pickle.loads(shared.value)
