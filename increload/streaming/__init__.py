from increload.streaming.micro_batch import load_stream

__all__ = ["load_stream"]
