from tallyloom.streaming.hourly import hourly_stream, run_once

__all__ = ["hourly_stream", "run_once"]
