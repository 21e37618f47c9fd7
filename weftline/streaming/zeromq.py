"""ZeroMQ sockets as a Spark data source and a sink, where the pyzmq package is installed."""

from __future__ import annotations

from ..types import ScriptError


def package():
    try:
        import zmq
    except ImportError:
        raise ScriptError("MODE ZMQ needs the Python package pyzmq, which isn't installed") from None
    return zmq


def register(spark) -> None:
    package()
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.address = options["address"]

        def initialOffset(self):
            return {"n": 0}

        def read(self, start):
            zmq = package()
            socket = zmq.Context.instance().socket(zmq.SUB)
            socket.connect(self.address)
            socket.setsockopt_string(zmq.SUBSCRIBE, "")
            rows = []
            while socket.poll(200):
                rows.append((socket.recv_string(),))
            socket.close()
            return iter(rows), {"n": start["n"] + len(rows)}

        def readBetweenOffsets(self, start, end):
            return iter(())

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "weftline-zmq"

        def schema(self):
            return "value string"

        def simpleStreamReader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


def publish(address: str, lines) -> None:
    zmq = package()
    socket = zmq.Context.instance().socket(zmq.PUB)
    socket.bind(address)
    for line in lines:
        socket.send_string(line)
    socket.close()
